"""The named queries: operators over the bound tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import measures, periods, text
from gaugeworks.operators import datasets, dedup, enrich, quality, ranking, rates
from gaugeworks.plans.binding import NORMAL, PPM, facts, members, reasons, routing, table, with_tables
from gaugeworks.sources import readers, writers
from gaugeworks.streaming import daily

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COMBO = ["process_type", "process", "ng", "kind", "key"]


def query(name: str, sql: str | None = None, tables: str = ""):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_tables(*tables.split(), sql=sql) if tables else sql
        return f

    return put


def grains(s, d, kinds="DWM"):
    return periods.by_grain(facts(s, d), kinds=kinds)


def routed(s, d):
    return enrich.route_with_fallback(facts(s, d), routing(s, d))


def rated(s, d, kinds="DWM"):
    """Quantities of each combination and period: summed by day first, so that fewer rows are copied to the grains."""
    return periods.by_grain(rates.quantities(routed(s, d), ["process_type", "process", "ng", "day"]), kinds=kinds)


def rated_kept(s, d, kinds="DWM"):
    """The same from daily sums that are written once, for reports that use them several times."""
    return periods.by_grain(writers.staged(rates.quantities(routed(s, d), ["process_type", "process", "ng", "day"]), "daily"), kinds=kinds)


def grouped(s, d):
    return enrich.expand_groups(facts(s, d), members(s, d))


ROUTES = f"""named AS (SELECT material, code, {NORMAL.format("process")} AS name, process_type, rid FROM routing), e AS (SELECT material, code, name, arg_min(process_type, rid) AS pt FROM named GROUP BY ALL),
  l AS (SELECT code, name, arg_min(process_type, rid) AS pt FROM named GROUP BY ALL)"""
ROUTE = "LEFT JOIN e ON f.material = e.material AND f.code = e.code AND f.process = e.name LEFT JOIN l ON f.code = l.code AND f.process = l.name"
ROUTED = f"WITH {ROUTES}, routed AS (SELECT f.*, coalesce(e.pt, l.pt, '') AS process_type FROM by_grain f {ROUTE})"
REASONED = "LEFT JOIN reason_of r ON lower(f.process) = r.p AND lower(f.ng) = r.n"
GROUPED = "WITH grouped AS (SELECT f.*, coalesce(m.grp, f.line_shift) AS grp FROM facts f LEFT JOIN members m USING (supplier))"
ROUND = "round({}, 6)"


def r6(c):
    return F.round(c, 6)


# --- sources -------------------------------------------------------------------------------------------------------

query("src01_scan", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
query("src02_equal", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2'")(lambda s, d: readers.where_all(table(s, d, "part"), {"p_brand": "Brand#2"}).select("p_partkey", "p_name"))
query("src03_all_equal", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'PROMO'")(lambda s, d: readers.where_all(table(s, d, "part"), {"p_brand": "Brand#2", "p_type": "PROMO"}).select("p_partkey"))


@query("src04_union_like_first", "SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT r_name, NULL FROM region")
def _(s, d):
    return readers.union_like_first([table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")), table(s, d, "region").select(F.col("r_name").alias("name"), F.lit(1).alias("other"))])


@query("src06_days_to_fetch", """SELECT CAST(g AS DATE) AS day, CASE WHEN CAST(g AS DATE) > DATE '1998-08-28' OR c.day IS NULL THEN 'fetch' ELSE 'cache' END AS source
  FROM generate_series(TIMESTAMP '1998-07-01', TIMESTAMP '1998-08-31', INTERVAL 1 DAY) t(g)
  LEFT JOIN (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) c ON c.day = CAST(g AS DATE)""")
def _(s, d):
    return readers.days_to_fetch(table(s, d, "orders").select(F.to_date("o_orderdate").alias("day")), "1998-07-01", "1998-08-31", "1998-08-31")


@query("src07_islands", """WITH x AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
  SELECT o_custkey, min(day) AS first_day, max(day) AS last_day FROM (SELECT o_custkey, day, day - CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS INTEGER) AS run FROM x) GROUP BY o_custkey, run""")
def _(s, d):
    return ranking.islands(table(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), by=("o_custkey",))


@query("src08_json_records", """SELECT n_name AS name, n_nationkey::VARCHAR AS id FROM nation""")
def _(s, d):
    one = F.concat(F.lit('{"data":{"contents":['), F.to_json(F.struct("n_nationkey", "n_name")), F.lit("]}}"))
    return readers.json_records(table(s, d, "nation").select(one.alias("body")), "body", {"n_name": "name", "n_nationkey": "id"})


@query("src20_group_json", "SELECT 'SPK' AS product_group, 'G' || r_regionkey AS group_name, n_name AS model FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    rows = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.collect_list("n_name"), lambda n: F.concat(F.lit('"'), n, F.lit('"'))), ",").alias("models"))
    body = F.concat(F.lit('{"ProductGroup":"SPK","Groups":[{"Index":0,"GroupName":"G'), F.col("n_regionkey").cast("string"), F.lit('","ModelList":['), F.col("models"), F.lit(",]},]}"))
    return readers.group_definitions(rows.select(body.alias("body")), "body")


query("snk06_upsert", "SELECT c_custkey, coalesce(n.seg, c_mktsegment) AS seg FROM customer LEFT JOIN (SELECT c_custkey AS k, 'NEW' AS seg FROM customer WHERE c_custkey % 3 = 0) n ON k = c_custkey")(
    lambda s, d: datasets.upsert(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), table(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("seg")), ["c_custkey"])
)
query("snk07_insert_missing", "SELECT n_nationkey AS k, 'old' AS v FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey >= 10")(
    lambda s, d: enrich.insert_missing(table(s, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.lit("old").alias("v")), table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit("new").alias("v")), ["k"], order="k")
)
query("snk08_jn10_replace_on_key", "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM nation")(
    lambda s, d: enrich.replace_on_key(table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit("old").alias("v")), table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.lit("new").alias("v")), ["k"])
)

# --- projections and predicates ------------------------------------------------------------------------------------


@query("prj_periods", """SELECT DISTINCT day, month(day)::INTEGER AS month, strftime(day, '%Y%m') AS month_key,
  ((dayofyear(day) - 1 + 7 - (isodow(day) - 1)) // 7 + 1)::INTEGER AS week_after_monday, ((dayofyear(day) - 1 + isodow(date_trunc('year', day)::DATE) - 1) // 7 + 1)::INTEGER AS week_first_monday,
  ((dayofyear(day) - 1 + dayofweek(date_trunc('year', day)::DATE)) // 7 + 1)::INTEGER AS week_first_sunday FROM (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem)""")
def _(s, d):
    day = F.col("day")
    return table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct().select(
        "day", F.month(day).alias("month"), periods.month_key(day).alias("month_key"), periods.week_after_monday(day).alias("week_after_monday"),
        periods.week_first_monday(day).alias("week_first_monday"), periods.week_first_sunday(day).alias("week_first_sunday"),
    )


query("prj08_labels", """SELECT DISTINCT kind, key, CASE kind WHEN 'D' THEN key[5:6] || '/' || key[7:8] WHEN 'W' THEN 'W' || right(key, 2)::INTEGER ELSE 'M' || right(key, 2)::INTEGER END AS label FROM by_grain""", "facts by_grain")(
    lambda s, d: grains(s, d).select("kind", "key").distinct().withColumn("label", periods.label(F.col("kind"), F.col("key")))
)
query("prj11_process_rank", "SELECT DISTINCT process_type, CASE process_type WHEN 'SUB' THEN 1 WHEN 'MAIN' THEN 2 WHEN 'FUNCTION' THEN 3 ELSE 4 END AS rank FROM routing", "facts routing")(
    lambda s, d: routing(s, d).select("process_type").distinct().withColumn("rank", text.process_rank(F.col("process_type")))
)
KINDS = "['sub line', 'Main', 'function test', ' Visual', 'packing'][p_size % 5 + 1]"
query("prj12_process_type", f"""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'SUB' WHEN 1 THEN 'MAIN' WHEN 2 THEN 'FUNCTION' WHEN 3 THEN 'VISUAL' ELSE 'packing' END AS kept,
  CASE p_size % 5 WHEN 0 THEN 'SUB' WHEN 1 THEN 'MAIN' WHEN 2 THEN 'FUNCTION' WHEN 3 THEN 'VISUAL' ELSE '' END AS dropped FROM (SELECT *, {KINDS} AS name FROM part)""")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("sub line", "Main", "function test", " Visual", "packing"))), (F.col("p_size") % 5 + 1).cast("int")).alias("name")).select("p_partkey", text.process_type(F.col("name")).alias("kept"), text.process_type(F.col("name"), False).alias("dropped"))
)
query("prj14_material", """SELECT DISTINCT line_shift, code, CASE WHEN code = 'P1' THEN material ELSE coalesce(nullif(regexp_extract(ls, '^(.+)_[^_]*$', 1), ''), ls) END AS material
  FROM (SELECT *, CASE WHEN code = 'P3' THEN line ELSE line_shift END AS ls FROM facts)""", "facts")(
    lambda s, d: facts(s, d).select("line_shift", "code", F.when(F.col("code") == "P1", F.col("material")).otherwise("").alias("m"), F.when(F.col("code") == "P3", F.col("line")).otherwise(F.col("line_shift")).alias("ls")).distinct()
    .select("line_shift", "code", text.material_of(F.col("m"), F.col("ls")).alias("material"))
)
query("flt01_members", "SELECT count(*) AS n, sum(input) AS input FROM facts WHERE line_shift IN ('Brand#2_L1', 'Brand#3_L0')", "facts")(
    lambda s, d: facts(s, d).where(F.col("line_shift").isin("Brand#2_L1", "Brand#3_L0")).agg(F.count("*").alias("n"), F.sum("input").alias("input"))
)
query("flt02_defects", "SELECT rid, ng_qty FROM facts WHERE ng_qty > 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'", "facts")(
    lambda s, d: facts(s, d).where("ng_qty > 0 and day between date'1996-01-01' and date'1996-01-31'").select("rid", "ng_qty")
)
query("flt05_contains", "SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), lower('BUILD'))")(lambda s, d: table(s, d, "customer").where(text.holds(F.col("c_mktsegment"), "BUILD")).select("c_custkey"))
query("flt06_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://')")(lambda s, d: table(s, d, "pages").where(text.under(F.col("url"), "https://")).select("page_id"))
query("flt07_flt11_tags", """WITH t AS (SELECT c_custkey, [lower(c_mktsegment), 's' || (c_nationkey % 4)] AS tags FROM customer)
  SELECT c_custkey, list_has_any(tags, ['building', 's1']) AS any_of, list_has_all(tags, ['building', 's1']) AS all_of FROM t""")(
    lambda s, d: table(s, d, "customer").select("c_custkey", F.array("c_mktsegment", F.concat(F.lit("S"), (F.col("c_nationkey") % 4).cast("string"))).alias("tags")).select("c_custkey", datasets.tags_any(F.col("tags"), ["Building", "S1"]).alias("any_of"), datasets.tags_all(F.col("tags"), ["Building", "S1"]).alias("all_of"))
)
query("flt09_overlap", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 10 DAY >= TIMESTAMP '1996-06-01' AND o_orderdate <= TIMESTAMP '1996-06-05'")(
    lambda s, d: table(s, d, "orders").where("o_orderdate + interval 10 days >= timestamp_ntz'1996-06-01' and o_orderdate <= timestamp_ntz'1996-06-05'").select("o_orderkey")
)

# --- joins ---------------------------------------------------------------------------------------------------------

query("jn01_route_fallback", f"WITH {ROUTES} SELECT f.code, coalesce(e.pt, l.pt, '') AS process_type, count(*) AS n FROM facts f {ROUTE} GROUP BY ALL", "facts routing")(lambda s, d: routed(s, d).groupBy("code", "process_type").agg(F.count("*").alias("n")))
query("jn02_route_exact", "SELECT code, coalesce(pt, '') AS process_type, count(*) AS n FROM facts LEFT JOIN (SELECT material, code, process, arg_max(process_type, rid) AS pt FROM routing GROUP BY ALL) USING (material, code, process) GROUP BY ALL", "facts routing")(
    lambda s, d: enrich.route_exact(facts(s, d), routing(s, d)).groupBy("code", "process_type").agg(F.count("*").alias("n"))
)
query("jn03_reason", f"SELECT f.ng, coalesce(r.reason, '') AS reason, count(*) AS n, sum(ng_qty) AS ng_qty FROM facts f {REASONED} GROUP BY ALL", "facts reasons reason_of")(
    lambda s, d: enrich.reason(facts(s, d), reasons(s, d)).groupBy("ng", "reason").agg(F.count("*").alias("n"), F.sum("ng_qty").alias("ng_qty"))
)
query("jn04_reason_exact", "SELECT ng, coalesce(reason, '') AS reason, count(*) AS n FROM facts LEFT JOIN (SELECT process, ng, arg_max(reason, rid) AS reason FROM reasons GROUP BY ALL) USING (process, ng) GROUP BY ALL", "facts reasons")(
    lambda s, d: enrich.reason_exact(facts(s, d), reasons(s, d)).groupBy("ng", "reason").agg(F.count("*").alias("n"))
)
query("jn05_update_from", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN (SELECT max(o_orderpriority) FROM orders WHERE o_custkey = c_custkey) ELSE c_mktsegment END AS tag FROM customer")(
    lambda s, d: enrich.update_from(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("tag")), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("tag")), ["c_custkey"], "tag")
)
query("jn06_missing_routing", "SELECT DISTINCT material, code, process FROM facts ANTI JOIN routing USING (material, code, process)", "facts routing")(lambda s, d: enrich.missing_keys(facts(s, d), routing(s, d), enrich.ROUTE))
query("jn07_missing_reasons", "SELECT DISTINCT process, ng FROM facts ANTI JOIN reasons USING (process, ng)", "facts reasons")(lambda s, d: enrich.missing_keys(facts(s, d), reasons(s, d), ["process", "ng"]))
query("jn08_vl03_coverage", """SELECT count(*) FILTER (k) AS applied_rows, count(*) FILTER (k IS NULL) AS missing_rows, count(DISTINCT (material, code, process)) FILTER (k IS NULL) AS missing_keys
  FROM facts LEFT JOIN (SELECT DISTINCT material, code, process, true AS k FROM routing) USING (material, code, process)""", "facts routing")(lambda s, d: enrich.coverage(facts(s, d), routing(s, d), enrich.ROUTE))
query("jn11_count_children", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(
    lambda s, d: enrich.with_children(table(s, d, "customer").select("c_custkey"), table(s, d, "orders"), "c_custkey", "o_custkey").withColumnRenamed("children", "orders")
)
query("jn13_scalar_subqueries", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n, (SELECT max(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey) AS most FROM supplier")(
    lambda s, d: enrich.with_children(table(s, d, "supplier").select("s_suppkey"), table(s, d, "lineitem"), "s_suppkey", "l_suppkey", most=F.max("l_quantity")).withColumnRenamed("children", "n")
)
query("jn14_groups", GROUPED + " SELECT grp, count(*) AS n, sum(input) AS input FROM grouped GROUP BY 1", "facts members")(lambda s, d: grouped(s, d).groupBy("grp").agg(F.count("*").alias("n"), F.sum("input").alias("input")))
query("jn17_same_files", "WITH f AS (SELECT url AS path, strlen(html) AS bytes, sha256(html) AS hash FROM pages), g AS (SELECT bytes, hash, min(path) AS first_path, count(*) AS copies FROM f GROUP BY ALL HAVING count(*) > 1) SELECT path, bytes, hash, first_path, copies FROM f JOIN g USING (bytes, hash)")(
    lambda s, d: datasets.same_files(table(s, d, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("bytes"), F.col("html").cast("binary").alias("content")))
)

# --- duplicates ----------------------------------------------------------------------------------------------------

KEY = ["line", "code", "process", "ng", "material", "month", "shift"]
FOLDED = """WITH x AS (SELECT *, strftime(day, '%Y%m') AS month FROM facts), best AS (SELECT * FROM x QUALIFY input = max(input) OVER (PARTITION BY {key})),
  r AS (SELECT {key}, list({{'i': input, 'n': ng_qty, 's': shift}} ORDER BY rid DESC, input DESC, ng_qty DESC) AS l FROM best GROUP BY {key})
  SELECT {key}, f.i AS input, f.n AS ng_qty FROM (SELECT *, list_reduce(l, lambda a, b: CASE WHEN (b.n = a.n{same}) OR b.n = 0 THEN a WHEN a.n = 0 THEN b ELSE {{'i': a.i, 'n': a.n + b.n, 's': a.s}} END) AS f FROM r)"""


@query("dd01_dd02_fold", FOLDED.format(key=", ".join(KEY), same=""), "facts")
def _(s, d):
    rows = facts(s, d).withColumns({"month": periods.month_key(F.col("day")), "line": F.concat(F.lit(" "), "line"), "ng": F.concat(F.lit("'"), "ng", F.lit("' "))})
    return dedup.fold(rows, KEY, ("process", "ng")).drop("rid")


@query("dd03_fold_with_shift", FOLDED.format(key="line, process, ng, month", same=" AND a.s = b.s"), "facts")
def _(s, d):
    return dedup.fold(facts(s, d).withColumn("month", periods.month_key(F.col("day"))), ["line", "process", "ng", "month"], ("process", "ng"), ("shift",)).drop("rid", "shift")


query("dd04_merge_repeats", "SELECT line, day, process, ng, ng_code, line_shift, avg(input) AS input, sum(ng_qty) AS ng_qty, arg_min(code, rid) AS code FROM facts GROUP BY ALL", "facts")(
    lambda s, d: dedup.merge_repeats(facts(s, d), ["line", "day", "process", "ng", "ng_code", "line_shift"], ["code"])
)
query("dd05_keep_last", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")(
    lambda s, d: dedup.keep_last(table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")
)
query("dd06_keep_first", "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY upper(trim(c_mktsegment)) ORDER BY c_custkey) = 1")(
    lambda s, d: dedup.keep_first(table(s, d, "customer").select("c_custkey", "c_mktsegment"), [text.normalize_key(F.col("c_mktsegment"))], "c_custkey")
)

# --- rates ---------------------------------------------------------------------------------------------------------

query("ag01_combo_ppm", ROUTED + f" SELECT process_type, process, ng, kind, key, {PPM} AS ppm FROM routed GROUP BY ALL", "facts routing by_grain")(lambda s, d: rates.combo_ppm(rated(s, d), COMBO))
COMBOS = ROUTED + f", c AS (SELECT process_type, process, ng, kind, key, {PPM} AS ppm FROM routed GROUP BY ALL)"
for _name, _by in (("ag02_type_ppm", ["process_type", "kind", "key"]), ("ag03_total_ppm", ["kind", "key"]), ("ag04_process_ppm", ["process_type", "process", "kind", "key"])):
    query(_name, f"{COMBOS} SELECT {', '.join(_by)}, sum(ppm) AS ppm FROM c GROUP BY ALL", "facts routing by_grain")(lambda s, d, by=_by: rates.summed_ppm(rated(s, d), COMBO, by))
query("ag08_group_total", f"{COMBOS}, t AS (SELECT process_type, kind, key, sum(ppm) AS ppm FROM c WHERE process_type <> '' GROUP BY ALL) SELECT * FROM t UNION ALL SELECT 'TOTAL', kind, key, sum(ppm) FROM t GROUP BY kind, key", "facts routing by_grain")(
    lambda s, d: rates.with_total(rated(s, d), COMBO, "process_type", ["kind", "key"])
)
query("ag06_group_process_ppm", GROUPED + f" SELECT grp, process, sum(ppm) AS ppm FROM (SELECT grp, process, ng, {PPM} AS ppm FROM grouped GROUP BY ALL) GROUP BY ALL", "facts members")(
    lambda s, d: rates.summed_ppm(grouped(s, d), ["grp", "process", "ng"], ["grp", "process"])
)
query("ag07_group_quantities", GROUPED + " SELECT grp, ng, sum(input) AS input, sum(ng_qty) AS ng_qty FROM grouped GROUP BY ALL", "facts members")(lambda s, d: rates.quantities(grouped(s, d), ["grp", "ng"]))
query("ag09_max_then_sum", """SELECT line, month, sum(i) AS input, sum(n) AS ng_qty FROM (SELECT line, line_shift, process, month, max(i) AS i, sum(n) AS n FROM (
  SELECT line, line_shift, process, ng, strftime(day, '%Y%m') AS month, sum(input) AS i, sum(ng_qty) AS n FROM facts GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", "facts")(
    lambda s, d: rates.max_then_sum(facts(s, d).withColumn("month", periods.month_key(F.col("day"))), ["line", "line_shift", "process", "ng", "month"], ["line", "month"])
)
query("ag10_group_detail", GROUPED + f" SELECT grp, process, ng, strftime(day, '%Y%m') AS key, {PPM} AS ppm FROM grouped GROUP BY ALL", "facts members")(
    lambda s, d: rates.combo_ppm(grouped(s, d).withColumn("key", periods.month_key(F.col("day"))), ["grp", "process", "ng", "key"])
)
query("ag11_line_detail", f"SELECT line_shift, process, ng, kind, key, {PPM} AS ppm FROM by_grain WHERE kind = 'M' GROUP BY ALL", "facts by_grain")(
    lambda s, d: rates.combo_ppm(grains(s, d, "M"), ["line_shift", "process", "ng", "kind", "key"])
)
query("ag14_reason_ppm", f"SELECT coalesce(r.reason, '') AS reason, kind, key, {PPM} AS ppm FROM by_grain f {REASONED} GROUP BY ALL", "facts reasons reason_of by_grain")(
    lambda s, d: rates.combo_ppm(periods.by_grain(rates.quantities(enrich.reason(facts(s, d), reasons(s, d)), ["reason", "day"])), ["reason", "kind", "key"])
)
query("ag14_reason_group_ppm", f"SELECT coalesce(r.reason, '') AS reason, coalesce(m.grp, f.line_shift) AS grp, kind, key, {PPM} AS ppm FROM by_grain f {REASONED} LEFT JOIN members m USING (supplier) GROUP BY ALL", "facts reasons reason_of members by_grain")(
    lambda s, d: rates.combo_ppm(periods.by_grain(rates.quantities(enrich.reason(grouped(s, d), reasons(s, d)), ["reason", "grp", "day"])), ["reason", "grp", "kind", "key"])
)
query("ag15_group_table", f"""WITH {ROUTES} SELECT f.process, f.ng, ng_code, day, sum(input) AS input, sum(ng_qty) AS ng_qty, arg_min(coalesce(e.pt, l.pt, ''), f.rid) AS process_type, arg_min(coalesce(r.reason, ''), f.rid) AS reason,
  arg_min(month(day), f.rid)::INTEGER AS month, arg_min((dayofyear(day) - 1 + 7 - (isodow(day) - 1)) // 7 + 1, f.rid)::INTEGER AS week FROM facts f {ROUTE} {REASONED} GROUP BY ALL""", "facts routing reasons reason_of")(
    lambda s, d: rates.group_table(enrich.reason(routed(s, d), reasons(s, d)).withColumns({"month": F.month("day"), "week": periods.week_after_monday(F.col("day"))}), ["process", "ng", "ng_code", "day"], ["process_type", "reason", "month", "week"])
)
query("ag17_recombined", GROUPED + """ SELECT process, round(sum(ppm), 4) AS ppm FROM (SELECT process, ng, CASE WHEN sum(input) > 0 THEN sum(ng_qty) / sum(input) * 1e6 ELSE 0.0 END AS ppm
  FROM grouped WHERE grp IN ('ASIA', 'EUROPE') GROUP BY ALL) GROUP BY ALL""", "facts members")(lambda s, d: rates.recombined(grouped(s, d), ["ASIA", "EUROPE"], ["process", "ng"], ["process"]).withColumn("ppm", F.round("ppm", 4)))
NT = "SELECT material, process, max(input) FILTER (line = 'L0') AS normal, max(input) FILTER (line = 'L1') AS test FROM facts GROUP BY ALL"


def compared(s, d):
    return datasets.normal_and_test(facts(s, d).withColumn("side", F.when(F.col("line") == "L0", "normal").when(F.col("line") == "L1", "test")), ["material", "process"], "side", "input")


query("ag20_prj17_improvement", f"SELECT *, CASE WHEN normal > 0 AND test IS NOT NULL THEN (normal - test) / normal * 100 END AS improvement FROM ({NT})", "facts")(compared)
query("ag21_kpis", f"SELECT count(*) FILTER (i > 0) AS improved, count(*) FILTER (i < 0) AS regressed, count(*) FILTER (i IS NULL) AS no_data, count(DISTINCT material) AS materials, round(avg(i), 6) AS mean FROM (SELECT material, CASE WHEN normal > 0 AND test IS NOT NULL THEN (normal - test) / normal * 100 END AS i FROM ({NT}))", "facts")(
    lambda s, d: compared(s, d).agg(F.count_if(F.col("improvement") > 0).alias("improved"), F.count_if(F.col("improvement") < 0).alias("regressed"), F.count_if(F.col("improvement").isNull()).alias("no_data"), F.countDistinct("material").alias("materials"), r6(F.avg("improvement")).alias("mean"))
)
query("ag25_range", "SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM facts", "facts")(lambda s, d: facts(s, d).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n")))
query("ag26_distinct_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT p_type FROM part")(
    lambda s, d: table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(table(s, d, "region").select(F.col("r_name").alias("name"))).unionByName(table(s, d, "part").select(F.col("p_type").alias("name"))).distinct()
)
query("ag27_counts", "SELECT o_orderpriority AS p, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus <> 'F') AS other FROM orders GROUP BY 1")(
    lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") != "F").alias("other"))
)
query("ag28_size_roll_up", """WITH f AS (SELECT split('root/' || source || '/' || lang || '/' || doc_id, '/') AS p, strlen(text) AS bytes FROM documents),
  x AS (SELECT array_to_string(p[:n], '/') AS folder, bytes FROM f, unnest([1, 2, 3]) t(n)), r AS (SELECT folder, sum(bytes)::BIGINT AS bytes, count(*) AS files FROM x GROUP BY 1)
  SELECT folder, bytes, files, round(bytes / (SELECT max(bytes) FROM r) * 100, 6) AS share FROM r""")(
    lambda s, d: datasets.size_roll_up(table(s, d, "documents").select(F.concat_ws("/", F.lit("root"), "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"))).withColumn("share", r6(F.col("share")))
)
query("ag29_drill_through", "SELECT count(*) AS rows, sum(input) AS input, sum(ng_qty) AS ng_qty, round(sum(ng_qty) / sum(input), 6) AS rate FROM facts WHERE process = '1-URGENT' AND ng = 'PROMO' AND line = 'L1'", "facts")(
    lambda s, d: readers.where_all(facts(s, d), {"process": "1-URGENT", "ng": "PROMO", "line": "L1"}).agg(F.count("*").alias("rows"), F.sum("input").alias("input"), F.sum("ng_qty").alias("ng_qty"), r6(F.sum("ng_qty") / F.sum("input")).alias("rate"))
)

# --- rankings ------------------------------------------------------------------------------------------------------

REF = ", w AS (SELECT * FROM c WHERE kind = 'W' AND key = (SELECT min(key) FROM (SELECT DISTINCT key FROM c WHERE kind = 'W' ORDER BY key DESC LIMIT 2)))"


def in_week(s, d, by):
    return rates.summed_ppm(ranking.in_reference(rated(s, d, "W")), COMBO, [*by, "kind", "key"])


query("wn01_wn02_top_processes", f"{COMBOS}{REF} SELECT process_type, process, key, ppm, row_number() OVER (ORDER BY ppm DESC, process_type, process)::INTEGER AS rank FROM (SELECT process_type, process, key, sum(ppm) AS ppm FROM w GROUP BY ALL) QUALIFY rank <= 10", "facts routing by_grain")(
    lambda s, d: ranking.top(in_week(s, d, ["process_type", "process"]).drop("kind"), 10, "ppm", ["process_type", "process"])
)
query("wn03_top_combos", f"{COMBOS}{REF} SELECT process_type, process, ng, key, ppm, row_number() OVER (ORDER BY ppm DESC, process_type, process, ng)::INTEGER AS rank FROM w QUALIFY rank <= 10", "facts routing by_grain")(
    lambda s, d: ranking.top(in_week(s, d, ["process_type", "process", "ng"]).drop("kind"), 10, "ppm", ["process_type", "process", "ng"])
)
query("wn08_rerank", GROUPED + """ SELECT process, round(ppm, 4) AS ppm, row_number() OVER (ORDER BY ppm DESC, process)::INTEGER AS rank FROM (SELECT process, sum(ppm) AS ppm FROM
  (SELECT process, ng, CASE WHEN sum(input) > 0 THEN sum(ng_qty) / sum(input) * 1e6 ELSE 0.0 END AS ppm FROM grouped WHERE grp IN ('ASIA', 'AFRICA') GROUP BY ALL) GROUP BY ALL) QUALIFY rank <= 4""", "facts members")(
    lambda s, d: ranking.top(rates.recombined(grouped(s, d), ["ASIA", "AFRICA"], ["process", "ng"], ["process"]), 4, "ppm", ["process"]).withColumn("ppm", F.round("ppm", 4))
)
query("wn10_fill", """WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS t FROM events)
  SELECT user_id, event_id, coalesce(last_value(t IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")(
    lambda s, d: ranking.fill(table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("t")), "user_id", "event_id", "t")
)
query("wn11_newest_periods", f"{COMBOS}, k AS (SELECT kind, key FROM (SELECT DISTINCT kind, key FROM c) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY key DESC) <= CASE kind WHEN 'D' THEN 10 WHEN 'W' THEN 4 ELSE 3 END) SELECT * FROM c SEMI JOIN k USING (kind, key)", "facts routing by_grain")(
    lambda s, d: rates.combo_ppm(ranking.newest(rated_kept(s, d), {"D": 10, "W": 4, "M": 3}), COMBO)
)
query("wn12_latest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 7")(lambda s, d: ranking.latest(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"], 7))

# --- sets and shapes -----------------------------------------------------------------------------------------------

query("set02_union_missing", "SELECT n_name AS name, n_nationkey AS a, NULL::INTEGER AS b FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")(
    lambda s, d: readers.union_all_columns([table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("a")), table(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("b"))])
)
query("set04_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(
    lambda s, d: enrich.difference(table(s, d, "customer").select(F.col("c_custkey").alias("k")), table(s, d, "orders"), "k", "o_custkey")
)
query("rs05_long_form", "SELECT p_partkey, unnest(['p_retailprice', 'p_size']) AS name, unnest([p_retailprice, p_size::DOUBLE]) AS y FROM part")(
    lambda s, d: quality.long_form(table(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), ["p_partkey"], ["p_retailprice", "p_size"])
)
query("rs08_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda s, d: datasets.json_fields(table(s, d, "events"), "props", ["k"]).select("event_id", "k"))
query("rs09_drop_key", "SELECT event_id, '{}' AS props FROM events")(lambda s, d: table(s, d, "events").select("event_id", datasets.drop_json_key("props", "k").alias("props")))

# --- text ----------------------------------------------------------------------------------------------------------

query("fn01_normalize", r"""SELECT doc_id, trim(regexp_replace(replace(replace(translate(replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), ' '), '‘’“”''"~+', '        '), '[', ''), ']', '_'), '[ \t\n\f\r\x0B]{2,}', ' ', 'g'), ' ') AS text FROM documents""")(
    lambda s, d: table(s, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("text"))
)
query("fn02_key", "SELECT p_partkey, upper(replace(trim(p_name, ' '), '  ', ' ')) AS k FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", text.normalize_key(F.col("p_name")).alias("k")))
TOKENS = "list_filter(list_distinct(list_transform(regexp_split_to_array(trim(regexp_replace(upper({}), '[^A-Z0-9-]+', ' ', 'g')), '[ -]+'), lambda w: CASE w WHEN 'VIS' THEN 'VISUAL' WHEN 'VSL' THEN 'VISUAL' WHEN 'FUNC' THEN 'FUNCTION' ELSE w END)), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+'))"
NAME = "p_name || CASE p_size % 4 WHEN 0 THEN '-vis/12' WHEN 1 THEN ' (func_VSL) 7' WHEN 2 THEN ' [x]+Test' ELSE '' END"


def noisy_name():
    """Part names with what the classifier has to read over."""
    size = F.col("p_size") % 4
    return F.concat("p_name", F.when(size == 0, "-vis/12").when(size == 1, " (func_VSL) 7").when(size == 2, " [x]+Test").otherwise(""))


query("fn04_tokens", f"SELECT p_partkey, list_sort({TOKENS.format(NORMAL.format('n'))}) AS t FROM (SELECT p_partkey, {NAME} AS n FROM part)")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.array_sort(text.tokens(noisy_name())).alias("t"))
)
query("fn05_safe_name", "SELECT c_custkey, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9가-힣]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", text.safe_name(F.col("c_name")).alias("name")))
query("fn10_holds_number", "SELECT c_custkey, regexp_matches(replace(c_name, ',', ''), '(^|[^0-9])' || c_custkey || '($|[^0-9])') AS held FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", text.holds_number(F.col("c_name"), F.col("c_custkey")).alias("held"))
)
query("fn13_head_tail", """SELECT page_id, sha256(CASE WHEN 2 * n >= length(h) THEN h ELSE left(h, n) || right(h, n) END) AS hash FROM (SELECT page_id, h, greatest(ceil(length(h) * 0.1), 1)::INTEGER AS n FROM (SELECT page_id, hex(html) AS h FROM pages))""")(
    lambda s, d: table(s, d, "pages").select("page_id", datasets.head_tail_hash(F.hex(F.col("html").cast("binary")).cast("binary")).alias("hash"))
)

# --- statistics ----------------------------------------------------------------------------------------------------

LIMITS = "WITH v AS (SELECT event_id, event_type AS name, user_id % 5 AS g, value AS y, 5.0 AS low, 60.0 AS high, epoch(ts) / 86400 AS x FROM events)"


def values(s, d):
    x = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400
    return table(s, d, "events").select("event_id", F.col("event_type").alias("name"), (F.col("user_id") % 5).alias("g"), F.col("value").alias("y"), F.lit(5.0).alias("low"), F.lit(60.0).alias("high"), x.alias("x"))


STATS = """SELECT {by}, count(y) AS n, count(*) FILTER (y > high OR y < low) AS ng, round(count(*) FILTER (y > high OR y < low) / count(y) * 100, 6) AS ng_pct, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS sigma,
  min(y) AS lowest, max(y) AS highest, round(least((60.0 - avg(y)) / (3 * stddev_pop(y)), (avg(y) - 5.0) / (3 * stddev_pop(y))), 6) AS cpk FROM v GROUP BY ALL"""


def rounded(df, *names):
    return df.withColumns({c: r6(F.col(c)) for c in names})


query("st01_st02_column_stats", f"{LIMITS} {STATS.format(by='name')}")(lambda s, d: rounded(quality.column_stats(values(s, d), ["name"]), "ng_pct", "mean", "sigma", "cpk"))
query("st07_st08_by_day", f"{LIMITS} {STATS.format(by='name, floor(x)::BIGINT AS day_no')}")(lambda s, d: rounded(quality.column_stats(values(s, d).withColumn("day_no", F.floor("x")), ["name", "day_no"]), "ng_pct", "mean", "sigma", "cpk"))
query("st03_st25_one_sided", f"{LIMITS} SELECT name, g, round(stddev_samp(y), 6) AS sigma, round((60.0 - avg(y)) / (3 * stddev_samp(y)), 6) AS cpk FROM v GROUP BY ALL")(
    lambda s, d: rounded(quality.one_sided_cpk(values(s, d).withColumn("low", F.lit(None).cast("double")), ["name", "g"]), "sigma", "cpk")
)
query("st04_failures", f"{LIMITS} SELECT name, count(*) AS n, count(*) FILTER (bad) AS ng, round(count(*) FILTER (bad) / count(*) * 100, 6) AS ng_pct FROM (SELECT name, event_id // 10 AS r, bool_or(y > high OR y < low) AS bad FROM v GROUP BY ALL) GROUP BY 1")(
    lambda s, d: rounded(quality.row_failures(values(s, d).withColumn("r", F.floor(F.col("event_id") / 10)), "r", ["name"]), "ng_pct")
)
query("st09_failed_groups", f"{LIMITS} SELECT count(*) AS n, count(*) FILTER (bad) AS ng, round(count(*) FILTER (bad) / count(*) * 100, 6) AS ng_pct FROM (SELECT event_id // 7 AS r, bool_or(y > high OR y < low) AS bad FROM v GROUP BY ALL)")(
    lambda s, d: rounded(quality.failed_groups(values(s, d).withColumn("r", F.floor(F.col("event_id") / 7)), "r"), "ng_pct")
)
query("st10_st11_regression", f"""{LIMITS} SELECT name, count(*) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_r2(y, x), 4) AS r2, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2)), 4) AS residual_sigma FROM v GROUP BY 1""")(
    lambda s, d: quality.regression(values(s, d), ["name"]).select("name", "n", *[F.round(c, 4).alias(c) for c in ("slope", "r2", "residual_sigma")])
)
query("st13_jn15_pairwise", """SELECT 'q' AS x_name, 'p' AS y_name, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope FROM lineitem UNION ALL SELECT 'q', 'd', count(*), round(regr_slope(l_discount, l_quantity), 4) + 0.0 FROM lineitem UNION ALL SELECT 'p', 'd', count(*), round(regr_slope(l_discount, l_extendedprice), 4) + 0.0 FROM lineitem""")(
    lambda s, d: quality.pairwise(table(s, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d")), ["q", "p", "d"]).select("x_name", "y_name", "n", F.round("slope", 4).alias("slope"))
)
query("st24_jitter", "SELECT event_id, round(value + ((event_id % 9) - 4) * 0.035, 6) AS x FROM events")(lambda s, d: table(s, d, "events").select("event_id", r6(F.col("value") + ((F.col("event_id") % 9) - 4) * 0.035).alias("x")))
# --- datasets ------------------------------------------------------------------------------------------------------

query("stream_daily_rates", """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS input, count(*) FILTER (value > 50) AS ng_qty, round_even(count(*) FILTER (value > 50) / count(*) * 1e6, 0) AS ppm FROM events GROUP BY ALL""")(
    lambda s, d: daily.daily_rates(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
)

# --- further parity ------------------------------------------------------------------------------------------------

query("flt03_out_of_limits", "SELECT event_id FROM events WHERE value > 60 OR value < 5")(lambda s, d: values(s, d).where(measures.out_of_limits(F.col("y"), F.col("low"), F.col("high"))).select("event_id"))
query("flt04_date_range", "SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'")(
    lambda s, d: table(s, d, "events").where(F.to_date("ts").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-05").cast("date"))).select("event_id")
)
query("flt08_later_as_text", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE strftime(l_shipdate, '%H:%M') <> '' AND l_returnflag > l_linestatus")(
    lambda s, d: table(s, d, "lineitem").where(measures.later(F.col("l_returnflag"), F.col("l_linestatus"))).select("l_orderkey", "l_linenumber")
)
query("jn12_left_join", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")(lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left"))


query("st05_without_x", "SELECT l_linenumber AS i, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sigma, min(l_quantity) AS lowest, max(l_quantity) AS highest FROM lineitem GROUP BY 1")(
    lambda s, d: rounded(quality.column_stats(table(s, d, "lineitem").select(F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("y"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")), ["i"]), "mean", "sigma").select("i", "n", "mean", "sigma", "lowest", "highest")
)
