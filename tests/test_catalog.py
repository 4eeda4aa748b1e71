"""Every query against its SQL on the smallest tables, and the rules that SQL can't show on small frames."""

import datetime
import re

import duckdb
import pytest
from gaugeworks.functions import measures, periods, text
from gaugeworks.operators import classifier, datasets, dedup, enrich, quality, ranking, rates, reports
from gaugeworks.plans import catalog, further, structures  # noqa: F401  (registers its queries)
from gaugeworks.sources import readers, writers
from gaugeworks.streaming import daily
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    want = duck.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(want.columns) == sorted(df.columns)
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rates_round_half_to_even(spark):
    assert [one(spark, measures.ppm(F.lit(n), F.lit(2e6))) for n in (5.0, 7.0, 0.0)] == [2.0, 4.0, 0.0]
    assert one(spark, measures.ppm(F.lit(5.0), F.lit(0.0))) == 0.0


def test_fold_rules_and_idempotence(spark):
    rows = [("a", 100.0, 3.0, "1"), ("a", 100.0, 2.0, "2"), ("a", 100.0, 2.0, "3"), ("a", 90.0, 9.0, "4"), ("b", 5.0, 0.0, "1"), ("b", 5.0, 4.0, "2"), ("c", 7.0, 0.0, "1"), ("c", 7.0, 0.0, "2")]
    df = spark.createDataFrame(rows, "k string, input double, ng_qty double, rid string")
    got = dedup.fold(df, ["k"])
    assert sorted((r.k, r.input, r.ng_qty) for r in got.collect()) == [("a", 100.0, 5.0), ("b", 5.0, 4.0), ("c", 7.0, 0.0)]
    assert sorted(map(tuple, dedup.fold(got, ["k"]).collect())) == sorted(map(tuple, got.collect()))


def test_week_rules_differ(spark):
    day = F.lit("2018-12-31").cast("date")
    assert [one(spark, f(day)) for f in (periods.week_first_monday, periods.week_first_sunday, periods.week_after_monday)] == [53, 53, 54]
    assert [p["kind"] for p in one(spark, periods.grains(day))] == ["D", "W", "M"] and one(spark, periods.grains(F.lit(None).cast("date"))) == []


def test_text_helpers(spark):
    assert one(spark, text.normalize(F.lit(" a“b”\n[c]~+  d "))) == "a b c_ d"
    assert one(spark, text.number_or_zero(F.lit("1,234.5"))) == 1234.5 and one(spark, text.number_or_zero(F.lit("x"))) == 0.0
    assert one(spark, text.percent(F.lit("12.5 %"))) == 12.5
    assert one(spark, text.parse_date(F.lit("03/04"), 2024)) == datetime.date(2024, 3, 4)
    assert one(spark, text.parse_date(F.lit("nope"), 2024)) is None
    assert one(spark, text.fenced_json(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert one(spark, text.sheet_name(F.lit("a/b:" + "c" * 40))) == "a_b_" + "c" * 27
    assert one(spark, text.safe_name(F.lit("--"))) == "Unnamed"
    assert one(spark, text.parse_date(F.lit("5-Jan-49"), 2024)) == datetime.date(2049, 1, 5) and one(spark, text.parse_date(F.lit("5-Jan-50"), 2024)) == datetime.date(1950, 1, 5)
    assert one(spark, text.criterion_label(F.lit("Frame deform"))) and not one(spark, text.criterion_label(F.lit(None).cast("string")))
    assert one(spark, text.material_of(F.lit(""), F.lit("_x"))) == "_x" and one(spark, text.material_of(F.lit(None).cast("string"), F.lit("a_b_c"))) == "a_b"


def test_joins_of_awkward_keys(spark):
    rows = spark.createDataFrame([("M", "1", "p"), (None, "1", "p"), ("X", "2", "q")], "material string, code string, process string")
    dim = spark.createDataFrame([(2, "M", "1", "p", "LATER"), (1, "M", "1", "'p", "SUB"), (3, "N", "1", "p", "MAIN")], "rid int, material string, code string, process string, process_type string")
    found = lambda df: sorted((str(r.material), r.process_type) for r in df.collect())
    assert found(enrich.route_with_fallback(rows, dim)) == [("M", "SUB"), ("None", "SUB"), ("X", "")]
    assert found(enrich.route_with_fallback(rows.withColumn("process_type", F.lit("OWN")), dim)) == [("M", "OWN"), ("None", "OWN"), ("X", "OWN")]
    assert found(enrich.route_exact(rows, dim)) == [("M", "LATER"), ("None", ""), ("X", "")]
    assert enrich.route_exact(rows.limit(0), dim).collect() == []
    names = spark.createDataFrame([("p", "n")], "process string, ng string")
    reasons = spark.createDataFrame([(2, "p", "n", "second"), (1, "P", "N", "first"), (3, "p", "n", "third"), (0, "", "n", "blank")], "rid int, process string, ng string, reason string")
    assert enrich.reason(names, reasons).first().reason == "first" and enrich.reason_exact(names, reasons).first().reason == "third"


def test_fold_with_shift_adds_what_only_differs_there(spark):
    rows = spark.createDataFrame([(" a ", 5.0, 3.0, "1", "x"), ("a", 5.0, 3.0, "2", "y")], "k string, input double, ng_qty double, rid string, shift string")
    assert [tuple(r) for r in dedup.fold(rows, ["k"]).select("k", "ng_qty").collect()] == [("a", 3.0)]
    assert [tuple(r) for r in dedup.fold(rows, ["k"], also=("shift",)).select("k", "ng_qty", "shift").collect()] == [("a", 6.0, "y")]


def test_issues_of_each_kind(spark):
    lot = lambda v, total, *defects, n=10: [(v, "test", "L", "c", n, n, total, f"d{i}", kind, count) for i, (kind, count) in enumerate(defects)]
    rows = lot("align", 5, ("__ALIGN_ERROR__", 0)) + lot("plain", 5, ("", 5)) + lot("criterion", 5, ("Wire Moving NG", 1)) + lot("uncounted", 5, ("a", 0), n=0) + lot("over", 2, ("a", 3))
    rows += lot("missing", 5, ("a", 0)) + lot("under", 5, ("a", 2), ("b", 1), ("", 9)) + lot("contradict", 0, ("a", 1)) + lot("right", 3, ("a", 1), ("b", 2))
    df = spark.createDataFrame(rows, "variable string, variable_group string, line string, check_type string, input int, ok int, ng_total int, variable_detail string, defect_type string, defect_count int")
    got = {r.variable: (r.issue, r.counted) for r in datasets.issues(df).collect()}
    assert got == {"align": ("align", 0), "missing": ("missing", 0), "under": ("undercount", 3), "contradict": ("contradict", 1)}


def test_classifier_stages_ties_and_no_labels(spark):
    train = spark.createDataFrame([(1, "alpha one", "B"), (2, "ALPHA ONE ", "C"), (3, "beta", "b"), (4, "gamma", "A")], "rid int, name string, label string")
    ask = spark.createDataFrame([("Alpha One",), ("[alpha]+one",), ("beta two",), ("visual check",), ("zeta",)], "name string")
    got = {r.name: (r.label, round(r.confidence, 2), r.source) for r in classifier.predict(ask, classifier.train(train, ("name",), "label"), classifier.by_keywords("name")).collect()}
    assert got == {"Alpha One": ("B", 1.0, "EXACT"), "[alpha]+one": ("B", 0.95, "NORMALIZED"), "beta two": ("B", 0.67, "ML"), "visual check": ("VISUAL", 0.99, "RULE"), "zeta": ("B", 0.55, "ML")}
    last = classifier.predict(ask, classifier.train(train, ("name",), "label", "last"))
    assert {r.name: r.label for r in last.collect()}["Alpha One"] == "C"
    empty = classifier.predict(ask, classifier.train(train.limit(0), ("name",), "label"), default=("MAIN", 0.5))
    assert {(r.label, r.confidence, r.source) for r in empty.collect()} == {("MAIN", 0.5, "ML")}
    with pytest.raises(ValueError):
        classifier.retrain(train, train.drop("label"), ("name",), "label")


def test_period_pivot_separates_kinds(spark):
    rows = spark.createDataFrame([("a", "D", "1", 2.0), ("b", "W", "7", 3.0), ("c", "D", "0", 1.0)], "k string, kind string, key string, ppm double")
    got = reports.period_pivot(rows, ["k"], [("D", "1"), ("W", "7")], {"ppm": F.col("ppm")})
    assert got.columns == ["k", "D1", "sep_W", "W7"] and sorted(map(tuple, got.collect())) == [("a", 2.0, None, 0.0), ("b", 0.0, None, 3.0)]


def test_curves_of_other_points_are_another_family(spark):
    points = [(c, x + 0.001, 1.0) for c in "ab" for x in (1.0, 2.0)] + [("c", 1.0, 1.0)]
    got = quality.aligned_curves(spark.createDataFrame(points, "curve string, x double, y double")).collect()
    assert {(r.curve, r.family) for r in got} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_inverse_normal_near_known_values(spark):
    known = {0.975: 1.959963985, 0.5: 0.0, 0.001: -3.090232306, 0.99: 2.326347874}
    assert all(abs(one(spark, measures.inverse_normal(F.lit(p))) - z) < 1e-6 for p, z in known.items())


def test_reference_period_with_one_period(spark):
    assert ranking.reference_period(spark.createDataFrame([("202401",)], "key string")).first().key == "202401"


def test_quadratic_finds_its_own_curve(spark):
    rows = spark.createDataFrame([("a", float(x), 2 - 3 * x + 0.5 * x * x) for x in range(9)], "g string, x double, y double")
    r = quality.quadratic(rows, ["g"]).first()
    assert [round(v, 6) for v in (r.a, r.b, r.c)] == [2.0, -3.0, 0.5]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x,x,\n1,2,3\n\n4,5\nx,x,\n")
    got = readers.delimited(spark, str(tmp_path / "a.txt"))
    assert got.columns == ["x", "x_2", "Column"] and sorted(map(tuple, got.collect())) == [("1", "2", "3"), ("4", "5", ""), ("x", "x", "")]
    (tmp_path / "late.txt").write_text("made by hand\na;b\n1; 2 \n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "late.txt"), header_row=2, least=2).collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        readers.delimited(spark, str(tmp_path / "late.txt"), header_row=2, least=3)
    assert readers.detect_delimiter(["a;b;c", "1;2;3"]) == ";" and readers.detect_delimiter(["abc"]) == "\t"
    (tmp_path / "m.tsv").write_text("h1\th2\n a \tb\nc\nh1\th2\n")
    assert sorted(map(tuple, readers.master_tsv(spark, str(tmp_path / "m.tsv"), ["p", "q"]).collect())) == [("a", "b"), ("c", ""), ("h1", "h2")]
    assert [tuple(r) for r in readers.strict_tsv(spark, str(tmp_path / "m.tsv"), ["p", "q"]).collect()] == [("a", "b"), ("h1", "h2")]
    (tmp_path / "s.txt").write_text("x\ty\n1\t2\n3 4\n5\n")
    assert sorted(map(tuple, readers.scatter(spark, str(tmp_path / "s.txt")).collect())) == [("1", "2"), ("3", "4"), ("5", None)]
    (tmp_path / "d.csv").write_text("2024-01-02,1.5,2\n2024-01-03,7\n")
    assert [tuple(r) for r in readers.dated_values(spark, str(tmp_path / "d.csv"), 2).collect()] == [(datetime.date(2024, 1, 2), 1.5, 2.0), (datetime.date(2024, 1, 3), 7.0, None)]
    (tmp_path / "bad.csv").write_text("soon,1\n")
    with pytest.raises(Exception, match="no date"):
        readers.dated_values(spark, str(tmp_path / "bad.csv"), 1).collect()


def test_cached_days_pass_over_broken_files(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "k int, day string").write.partitionBy("day").parquet(str(tmp_path / "days"))
    (tmp_path / "days" / "day=2024-01-02" / "broken.parquet").write_text("not a table")
    got = readers.cached_days(spark, str(tmp_path / "days"), ["2024-01-02", "2024-01-09"], "k int")
    assert [(r.k, str(r.day)) for r in got.collect()] == [(2, "2024-01-02")]


def test_first_table_with_rows_gives_the_columns(spark):
    a, b = spark.createDataFrame([], "x int"), spark.createDataFrame([(1, 2)], "y int, z int")
    assert readers.union_like_first([a, b]).columns == ["y", "z"] and readers.union_like_first([a, a]).columns == ["x"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, "c")], "k int, v string")
    writers.tsv(df, str(tmp_path / "t"))
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {"1\ta b", "2\tc", "k\tv"}
    writers.replace_partitions(df, str(tmp_path / "p"), ["k"])
    writers.replace_partitions(df.where("k = 2").withColumn("v", F.lit("new")), str(tmp_path / "p"), ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "a\tb"), (2, "new")}
    writers.overwrite(df, str(tmp_path / "o"))
    writers.append(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_tsv_of_several_files_comes_back_as_it_was(spark, tmp_path):
    texts = [" lead", "trail ", "", None, "\x00nul", "a\x00b", "#c", "back\\slash\\", '"q" x"', "   ", "\t", "text", "\x0b\x0c", "doc_id\ttext", "a\r\n\tb", "\x1f\x00 "]
    rows = [(str(i) if i % 3 else "\x00" + str(i), t) for i, t in enumerate(texts * 4)]
    writers.tsv(spark.createDataFrame(rows, "k string, v string").repartition(4), str(tmp_path / "t"))
    lines = readers.numbered_lines(spark, str(tmp_path / "t"))
    assert len({r.file for r in lines.collect()}) == 4
    want = sorted((k, re.sub(r"[\t\r\n]+", " ", t or "")) for k, t in rows)
    assert sorted(tuple(r.value.split("\t")) for r in lines.where("not (first and line = 1)").collect()) == want
    spark.createDataFrame([(k, t) for (k, _), t in zip(rows, texts * 4, strict=True)], "doc_id string, text string").repartition(3).write.parquet(str(tmp_path / "d/documents.parquet"))
    assert sorted(map(tuple, catalog.QUERIES["snk05_tsv"](spark, str(tmp_path / "d")).collect())) == want
    readers.KNOWN, known = 0, readers.KNOWN
    try:
        assert readers.numbered_lines(spark, str(tmp_path / "t")).where("first and line = 1").count() == 4
    finally:
        readers.KNOWN = known


def test_means_of_equal_rates_round_as_in_sql(spark):
    rows = [(f"S{k}", v, " ", "test", "", 0.12) for k in range(5, 30) for v in ["A"] * k + ["B"]]
    schema = "dataset string, variable string, variable_detail string, variable_group string, defect_type string, ng_rate double"
    con = duckdb.connect()
    con.execute("CREATE TABLE r (dataset VARCHAR, variable VARCHAR, p DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", [(r[0], r[1], r[5]) for r in rows])
    want = con.sql("SELECT dataset, arg_min(variable, (p, variable)), arg_max(variable, (p, variable)) FROM (SELECT dataset, variable, avg(p) AS p FROM r GROUP BY ALL) GROUP BY 1 ORDER BY 1").fetchall()
    for parts in (1, 3, 7):
        found = rates.best_and_worst(spark.createDataFrame(rows, schema).repartition(parts), "dataset")
        assert sorted((r.dataset, r.best, r.worst) for r in found.collect()) == want


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = daily.daily_rates(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, daily.daily_rates(events).collect()))
