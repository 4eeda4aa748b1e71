"""Trees, merges, dates, files, streams and intervals on small frames, with rules and figures that SQL can't show."""

import datetime
import hashlib
import itertools
import json
import math
import random
import re

import pytest
from gaugeworks.functions import text
from gaugeworks.operators import classifier, enrich, hulls, intervals, learning, rates, reports, trees
from gaugeworks.plans import catalog, structures  # noqa: F401  (registers its queries)
from gaugeworks.sources import files, many, stored, writers
from gaugeworks.streaming import refetch
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


ITEMS = "grp string, material string, path string, line_shift string, rid int"


def test_tree_makes_the_nodes_between(spark):
    rows = [("g", "m", "a\x1fb\x1fc", "x_1", 1), ("g", "m", "a", "x_2", 3), ("g", "m", "a\x1fb\x1fc", "x_0", 2), ("g", "m", None, "x_3", 4), ("g", "", None, "n_9_d", 0), ("g", "m", "z", "", 5)]
    found = trees.nested_tree(spark.createDataFrame(rows, ITEMS)).collect()
    node = lambda name, shifts, *below: {"name": name, "line_shifts": shifts, "sub_groups": list(below)}
    want = [
        {"material": "n_9", "sub_groups": [node("", ["n_9_d"])]},
        {"material": "m", "sub_groups": [node("a", ["x_2"], node("b", [], node("c", ["x_1", "x_0"]))), node("", ["x_3"]), node("z", [])]},
    ]
    assert len(found) == 1 and found[0].grp == "g" and json.loads(found[0].tree) == want


def test_tree_of_quoted_names_and_of_nothing(spark):
    rows = [("g", 'a"b\\', 'x"\x1fy,', 'l"s', 1), ("g", None, None, None, 2), (None, "m", "p", "q", 3)]
    found = {r.grp: json.loads(r.tree) for r in trees.nested_tree(spark.createDataFrame(rows[:2], ITEMS)).collect()}
    assert found["g"][0] == {"material": 'a"b\\', "sub_groups": [{"name": 'x"', "line_shifts": [], "sub_groups": [{"name": "y,", "line_shifts": ['l"s'], "sub_groups": []}]}]}
    assert found["g"][1] == {"material": "", "sub_groups": [{"name": "", "line_shifts": [], "sub_groups": []}]}
    assert trees.nested_tree(spark.createDataFrame([], ITEMS)).collect() == []


def test_update_where_null_keys_equal_empty_ones(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x", "c"), (4, "y", "d")], "id int, k string, v string")
    changes = spark.createDataFrame([("", "1"), (None, "2"), ("x", None)], "k string, v string")
    assert sorted(map(tuple, enrich.update_from(rows, changes, ["k"], "v").collect())) == [(1, None, "2"), (2, "", "2"), (3, "x", None), (4, "y", "d")]


def test_merge_takes_the_first_of_repeated_new_keys(spark):
    old = spark.createDataFrame([("a", "p 1", "OLD")], "m string, p string, t string")
    new = [(3, "b", "q", "third"), (1, "b", "'q'", "first"), (2, " b", "q ", "second"), (4, "", "q", "blank"), (5, "b", None, "null"), (6, "a", "p  1", "known")]
    found = enrich.insert_missing(old, spark.createDataFrame(new, "rid int, m string, p string, t string"), ["m", "p"], ("m", "p"))
    assert sorted(map(tuple, found.collect())) == [("a", "p 1", "OLD"), ("b", "q", "first")]


@pytest.mark.parametrize(
    ("written", "day"),
    [
        ("2024-03-05T10:11:12", (2024, 3, 5)), ("2024-3-5 23:59:59.5", (2024, 3, 5)), ("3/5/2024 1:02 PM", (2024, 3, 5)), ("March 5, 2024", (2024, 3, 5)), ("tue, 5 mar 2024 10:00", (2024, 3, 5)),
        ("2024-03-05T23:00:00-05:00", (2024, 3, 6)), ("2024-03-05T01:00:00+09:00", (2024, 3, 4)), ("2024-02-30T10:00:00", None), ("13/5/2024", None), ("2024-03-05 24:01", None), ("3/5/2024 13:00 PM", None),
        ("Foo 5, 2024", None), ("", None), (None, None), ("5-Mar", (2023, 3, 5)),
    ],
)
def test_general_dates(spark, written, day):
    found = spark.createDataFrame([(written,)], "t string").select(text.parse_date(F.col("t"), 2023).alias("d")).first().d
    assert found == (day and datetime.date(*day))


def test_totals_are_one_pass(spark):
    rows = [("MAIN", "p", "x", "A", "M", "1", 100.0, 1.0), ("MAIN", "p", "y", "A", "M", "1", 100.0, 2.0), ("SUB", "q", "x", "B", "M", "1", 50.0, 1.0), ("", "r", "x", "A", "M", "2", 10.0, 1.0)]
    spark.createDataFrame(rows, "process_type string, process string, ng string, grp string, kind string, key string, input double, ng_qty double").createOrReplaceTempView("rows_of_totals")
    df = spark.table("rows_of_totals")
    found = reports.detail_pivot(df, [("M", "1"), ("M", "2")], ["A", "B"])
    got = {(r.place, r.process_type, r.process, r.ng): tuple(r)[4:] for r in found.collect()}
    assert got[1, "TOTAL", "", ""] == (30000.0, 20000.0, 100000.0, 0.0) and got[2, "MAIN", "", ""] == (30000.0, 0.0, 0.0, 0.0) and got[3, "SUB", "q", "x"] == (0.0, 20000.0, 0.0, 0.0)
    assert len(got) == 1 + 3 + 4
    for one in (found, rates.with_total(df, ["process_type", "process", "ng", "kind", "key"], "process_type", ["kind", "key"])):
        assert len(re.findall(r"^\(\d+\) Scan ExistingRDD", plan_of(one), re.MULTILINE)) == 1


def test_heads_and_tails_are_read_and_no_more(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")  # Spark's scans pass over it
    sizes = {"one": 1, "ten": 10, "big": 3_000_001, "odd name #1%20": 2_500_000}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(bytes(i * 7 % 251 for i in range(size)))
    index = {r.name: r for r in files.file_index(spark, f"file://{tmp_path}").collect()}
    assert {n: r.bytes for n, r in index.items()} == sizes
    for name, size in sizes.items():
        data, n = (tmp_path / name).read_bytes(), max(1, math.ceil(size * 0.1))
        assert index[name].hash == hashlib.sha256(data if 2 * n >= size else data[:n] + data[-n:]).hexdigest().upper()
    assert sum(r.bytes_read for r in index.values()) < sum(sizes.values()) / 4
    assert index["big"].directory.endswith(tmp_path.name)


def test_known_files_are_not_opened_and_only_candidates_are_read_whole(spark, tmp_path):
    base = bytes(100_000)
    for name, data in {"a": base, "b": base, "c": base[:50_000] + b"x" + base[50_001:], "d": base + b"1", "e": base + b"2"}.items():
        (tmp_path / name).write_bytes(data)
    index = writers.staged(files.file_index(spark, f"file://{tmp_path}"), "index")
    (tmp_path / "f").write_bytes(base)
    again = {r.name: r for r in files.file_index(spark, f"file://{tmp_path}", index).collect()}
    assert [n for n, r in sorted(again.items()) if not r.reused] == ["f"] and sum(r.bytes_read for r in again.values()) == 20_000
    same = {r.path[-1]: (r.first_path[-1], r.copies) for r in files.same_files(files.file_index(spark, f"file://{tmp_path}")).collect()}
    assert same == {"a": ("a", 3), "b": ("a", 3), "f": ("a", 3)}  # c has their size and ends, d and e are alone
    gone = spark.createDataFrame([(f"file:{tmp_path}/none", 5)], "path string, bytes bigint")
    assert files.hashed(gone).first().hash is None


def test_files_of_pages_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a=1/b", "x"), ("a=2/b", None), ("a=1/c", "é\n"), ("a=2/b", "y")], "place string, value string")
    path = f"file://{tmp_path}/each"
    for _ in range(2):  # a task that runs again replaces its files
        files.write_each(rows, path)
    made = {str(p.relative_to(tmp_path / "each")): p.read_bytes() for p in (tmp_path / "each").rglob("*") if p.is_file()}
    assert made.pop("a=2/b") in (b"\ny\n", b"y\n\n") and made == {"a=1/b": b"x\n", "a=1/c": "é\n\n".encode()}


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_files_of_pages_are_written_to_a_shared_folder_named_in_any_form(spark, tmp_path, monkeypatch, form):
    pages = spark.createDataFrame([(1, "u", "a"), (3, "v", "b"), (4, "w", "a"), (5, "x", None)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/tables/pages.parquet")
    root, made = form.format(tmp_path / "shared folder#1%20"), itertools.count()
    monkeypatch.setattr(writers, "scratch", lambda _, name: f"{root}/{name}-{next(made)}")  # as spark.checkpoint.dir can't be set in a session
    index, same = (catalog.QUERIES[n](spark, f"{tmp_path}/tables").collect() for n in ("src23_file_index", "jn17_same_files_on_disk"))
    assert sorted((r.page_id, r["copy"], r.bytes, r.reused) for r in index) == [(1, 0, 2, True), (3, 0, 2, True), (3, 1, 2, False), (4, 0, 2, True), (5, 0, 1, True)]
    assert sorted((r.page_id, r["copy"], r.first_path, r.copies) for r in same) == [(1, 0, "page_id=1/copy=0", 2), (3, 0, "page_id=3/copy=0", 2), (3, 1, "page_id=3/copy=0", 2), (4, 0, "page_id=1/copy=0", 2)]


def test_many_folders_are_listed_and_scanned_in_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f").write_bytes(b"%d" % i)
    spark.sparkContext.setJobGroup("few", "")
    found = files.file_index(spark, f"file://{tmp_path}")
    assert found.count() == 200 and found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert max(s.numTasks for s in stages if s) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_each_file_has_its_own_delimiter_and_header(spark, tmp_path):
    texts = {
        "a.txt": "k;name;K;\n1; two words ;3;4\n\n2;x\n", "b.txt": "k\tname\n1\ta,b;c\n", "c.txt": "k|n\n1|2|3\n", "d.txt": "alone\nx\n", "e.txt": "", "f.csv": "a,b,a,A\n1,2,3,4\n",
    }
    for name, body in texts.items():
        (tmp_path / name).write_text(body)
    found = {}
    for r in many.delimited_files(spark, f"file://{tmp_path}").collect():
        found.setdefault(re.sub(".*/", "", r.file), []).append([tuple(f) for f in r.fields])
    assert sorted(found) == ["a.txt", "b.txt", "c.txt", "d.txt", "f.csv"]
    assert sorted(found["a.txt"]) == [[("k", "1"), ("name", "two words"), ("K_2", "3"), ("Column", "4")], [("k", "2"), ("name", "x"), ("K_2", ""), ("Column", "")]]
    assert found["b.txt"] == [[("k", "1"), ("name", "a,b;c")]] and found["c.txt"] == [[("k", "1"), ("n", "2")]] and found["d.txt"] == [[("alone", "x")]]
    assert found["f.csv"] == [[("a", "1"), ("b", "2"), ("a_2", "3"), ("A_3", "4")]]
    assert {re.sub(".*/", "", r.file): r.delimiter for r in many.headers(spark, f"file://{tmp_path}").collect()} == {"a.txt": ";", "b.txt": "\t", "c.txt": "|", "d.txt": "\t", "f.csv": ","}


def test_later_header_rows_of_many_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("made by hand\n\nx,y\n1,2\n")
    (tmp_path / "b.txt").write_text("too short\n")
    assert [[tuple(f) for f in r.fields] for r in many.delimited_files(spark, f"file://{tmp_path}", 3).collect()] == [[("x", "1"), ("y", "2")]]


def fetched(spark, rows):
    return spark.createDataFrame([(i, datetime.date(2024, 1, d), datetime.date(2024, 1, f)) for i, d, f in rows], "id int, day date, fetched date")


def test_fetches_replace_recent_days_and_keep_older_ones(spark, tmp_path):
    path = f"file://{tmp_path}/days"
    state = lambda: sorted((r.id, r.day.day) for r in spark.read.schema("id int, day date").parquet(path).collect())
    refetch.take(fetched(spark, [(1, 8, 10), (2, 10, 10)]), path)
    assert state() == [(1, 8), (2, 10)]
    later = [(3, 8, 12), (4, 10, 12), (5, 12, 12), (6, 5, 12)]  # day 8 is too old to change, day 5 wasn't there
    for _ in range(2):  # taken again after a failure
        refetch.take(fetched(spark, later), path)
        assert state() == [(1, 8), (4, 10), (5, 12), (6, 5)]
    refetch.take(fetched(spark, [(8, 12, 14), (7, 12, 13), (9, 11, 13)]), path)  # two fetches at once, in their order
    assert state() == [(1, 8), (4, 10), (6, 5), (8, 12), (9, 11)]


def test_stream_of_fetches_goes_on_after_a_restart(spark, tmp_path):
    arriving, path, progress = (f"file://{tmp_path}/{n}" for n in ("in", "out", "progress"))
    want = {}
    for day in range(1, 6):
        fetched(spark, [(day * 10 + d, d, day) for d in range(max(1, day - 4), day + 1)]).coalesce(1).write.mode("append").parquet(arriving)
        want |= {d: day * 10 + d for d in range(max(1, day - 2), day + 1)}
        refetch.follow(spark.readStream.schema("id int, day date, fetched date").parquet(arriving), path, progress).awaitTermination()
    assert {r.day.day: r.id for r in spark.read.schema("id int, day date").parquet(path).collect()} == want


def brute_hull(points):
    """Points that no two others have on or between them, by their angles: corners are those outside all others' hull."""
    points = sorted(set(points))
    if len(points) < 3:
        return set(points)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = [(a, b) for a in points for b in points if a != b and all(turn(a, b, c) >= 0 for c in points)]
    ends = {p for e in edges for p in e}
    between = lambda p: any(turn(a, b, p) == 0 and min(a, b) < p < max(a, b) for a in ends for b in ends if p not in (a, b))
    return {p for p in ends if not between(p)}


def test_hulls_by_brute_force(spark):
    rng = random.Random(3)
    groups = {
        "square": [(x, y) for x in range(5) for y in range(5)], "one": [(1, 1)] * 3, "two": [(1, 1), (2, 5)], "line": [(i, 2 * i) for i in range(9)], "upright": [(3, i) for i in range(6)],
        "level": [(i, 3) for i in range(6)], "circle": [(x, y) for x in range(-25, 26) for y in range(-25, 26) if x * x + y * y in (625, 169, 25)],
        **{f"random {n}": [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(60)] for n in (3, 10, 50)},
    }
    rows = spark.createDataFrame([(g, float(x), float(y)) for g, points in groups.items() for x, y in points] + [("square", None, 99.0), ("square", 99.0, None)], "g string, x double, y double")
    for salts in (1, 5):
        found = {}
        for r in hulls.convex_hull(rows, "g", salts).orderBy("g", "corner").collect():
            found.setdefault(r.g, []).append((r.x, r.y))
        assert {g: set(p) for g, p in found.items()} == {g: brute_hull(points) for g, points in groups.items()}
        for g, corners in found.items():
            assert len(corners) == len(set(corners)) and corners[0] == min(corners)
            area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
            assert area >= 0, g  # counter-clockwise
    plan = plan_of(hulls.convex_hull(rows, "g"))
    assert "Pandas" not in plan and "Arrow" not in plan
    inner = hulls.without_inner(rows.dropna(), "g").where("g = 'square'").count()
    assert inner < 25


def test_overlaps_by_brute_force(spark):
    rng = random.Random(4)

    def side(n):
        spans = [(i, s, s + rng.choice([0, 0, 3, 40, 900, 20_000, 5_000_000])) for i, s in ((i, rng.randrange(-3000, 3000)) for i in range(n))]
        return [*spans, (n, 5, None), (n + 1, None, 5), (n + 2, 50, 20), (n, 7, 7), (n, 7, 7)]

    left, right = side(80), side(60)
    frames = [spark.createDataFrame(r, "id int, low int, high int") for r in (left, right)]
    span = (F.col("low"), F.col("high"))
    want = sorted((a[0], b[0]) for a in left for b in right if None not in (*a, *b) and a[2] >= b[1] and a[1] <= b[2])
    for width in (1, 7, 100_000):
        found = intervals.overlapping(*frames, span, span, width)
        assert sorted((r.left.id, r.right.id) for r in found.collect()) == want
        assert "NestedLoop" not in plan_of(found) and "CartesianProduct" not in plan_of(found)
    assert intervals.overlapping(frames[0], frames[1].limit(0), span, span, 7).collect() == []


def test_totals_of_overlaps_make_no_pairs_of_rows(spark):
    rng = random.Random(6)
    rows = lambda n: [(i, a, a + rng.choice([0, 2, 30])) for i, a in ((i, rng.randrange(40)) for i in range(n))] + [(n, 3, None), (n + 1, None, 3)]
    left, right, span = rows(60), rows(50), (F.col("low"), F.col("high"))
    frames = [spark.createDataFrame(r, "id int, low int, high int") for r in (left, right)]
    met = {a[0]: [b[0] for b in right if None not in (*a, *b) and a[2] >= b[1] and a[1] <= b[2]] for a in left}
    found = intervals.overlap_totals(*frames, span, span, 4, "id").collect()
    assert sorted((r.id, r.n, r.lowest) for r in found) == sorted((k, len(v), min(v)) for k, v in met.items() if v)
    same = spark.range(1_000_000).select("id", F.lit(5).alias("low"), F.lit(6).alias("high"))  # a million million pairs
    got = intervals.overlap_totals(same, same, span, span, 4, "id").agg(F.count("*"), F.min("n"), F.max("n"), F.max("lowest")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 1_000_000, 0)


def parts_of(path):
    return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in path.rglob("*.parquet")}


def test_upserts_rewrite_only_the_parts_they_touch(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "k string, v string, seq int"
    rows = {str(i): f"old {i}" for i in range(300)} | {None: "null"}
    stored.create(spark.createDataFrame([(k, v, 0) for k, v in rows.items()], schema), path, ["k"])
    before = parts_of(tmp_path / "t")
    new = [("7", "first", 1), ("7", "last", 2), (None, "changed", 1), ("new", "added", 1)]
    touched = stored.upsert(spark, path, spark.createDataFrame(new, schema), schema, ["k"], "seq")
    after = parts_of(tmp_path / "t")
    want = rows | {"7": "last", None: "changed", "new": "added"}
    assert sorted((r.k, r.v) for r in stored.read(spark, path, schema).collect() if r.k) == sorted((k, v) for k, v in want.items() if k)
    assert stored.read(spark, path, schema).where("k is null").first().v == "changed"
    assert {k for k in after if before.get(k) != after[k]} == {f"part_of_key={p}" for p in touched} and len(touched) <= 3
    assert stored.upsert(spark, path, spark.createDataFrame([], schema), schema, ["k"], "seq") == [] and parts_of(tmp_path / "t") == after


def test_replacing_all_rows_of_a_key(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "name string, v int"
    stored.create(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema), path, ["name"], 4)
    stored.replace_on_key(spark, path, spark.createDataFrame([(9, "a"), (9, "a"), (8, "c")], "v int, name string"), schema, ["name"], 4)
    assert sorted(map(tuple, stored.read(spark, path, schema).collect())) == [("a", 9), ("a", 9), ("b", 3), ("c", 8)]


def test_batches_teach_what_their_union_does_after_a_restart(spark, tmp_path):
    base = [("pump a", "MAIN", "1"), ("pump b", "SUB", "2"), ("valve test", "VISUAL", "3"), ("pump a", "SUB", "4"), ("x", " ", "5")]
    one, two = [("pump a", "FIXED", "1"), ("new thing", "main", "2")], [("valve b", "Sub", "1"), ("pump a", "LAST", "2")]
    frame = lambda rows: spark.createDataFrame(rows, "name string, label string, rid string")
    whole = frame([(n, t, f"{b}{r}") for b, rows in enumerate((base, one, two)) for n, t, r in rows if t.strip()])
    path = f"file://{tmp_path}/taught"
    learning.start(frame(base), path, ("name",), "label", 8)
    learning.learn(frame(one), path, ("name",), "label", 1, 8)
    before = parts_of(tmp_path / "taught")
    touched = learning.learn(frame(two), path, ("name",), "label", 2, 8)
    changed = {k for k, v in parts_of(tmp_path / "taught").items() if before.get(k) != v}
    assert changed == {f"part_of_key={p}" for p in touched}
    again = spark.newSession()
    asked = [("pump a",), ("PUMP B",), ("valve",), ("pump x new",), ("nothing",)]
    for wins in ("first", "last"):
        found = classifier.predict(again.createDataFrame(asked, "name string"), learning.model(again, path, ("name",), "label", wins))
        want = classifier.predict(spark.createDataFrame(asked, "name string"), classifier.train(whole, ("name",), "label", wins))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="no column label"):
        learning.learn(frame(one).drop("label"), path, ("name",), "label", 3, 8)


def test_tallies_explode_distinct_names_dealt_evenly(spark):
    rows = [(n, t, f"{i:04}") for i, (n, t) in enumerate([("pump a", "Main"), ("pump a", "MAIN"), ("pump b", "SUB"), ("x", " ")] * 50)]
    found = learning.tallies(spark.createDataFrame(rows, "name string, label string, rid string").coalesce(1), ("name",), "label", 3)
    got = {(r["kind"], r["token"], r["l"]): (r["n"], r["first"]["at"]["rid"], r["first"]["label"], r["last"]["at"]["rid"], r["last"]["label"]) for r in found.collect()}
    assert got["prior", "", "main"] == (100, "0000", "Main", "0197", "MAIN") == got["vote", "PUMP", "main"] and got["vote", "B", "sub"] == (50, "0002", "SUB", "0198", "SUB")
    assert {k[0] for k in got} == {"prior", "exact", "normal", "vote"} and not any(k[1].lower() == "x" for k in got)
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    exploded = tree.index("Generate explode")
    assert exploded < tree.index("Aggregate", exploded) < tree.index("RepartitionByExpression", exploded)  # from the last step to the first
