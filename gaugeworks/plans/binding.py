"""The domain's tables over the supplied star schema, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.text import normalize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production and defect rows: material, line, code, process, ng, ng_code, shift, day, input, ng_qty, line_shift, supplier, rid.

    Names are normalised as rows are loaded.
    """
    items, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    rows = items.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(parts.select("p_partkey", "p_brand", "p_size", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    line = F.concat(F.lit("L"), (F.col("l_suppkey") % 5).cast("string"))
    return rows.select(
        F.col("p_brand").alias("material"),
        line.alias("line"),
        F.concat(F.lit("P"), (F.col("p_size") % 10).cast("string")).alias("code"),
        normalize(F.col("o_orderpriority")).alias("process"),
        F.col("p_type").alias("ng"),
        F.concat(F.lit("N"), (F.col("p_size") % 7).cast("string")).alias("ng_code"),
        F.col("l_linestatus").alias("shift"),
        F.to_date("l_shipdate").alias("day"),
        F.col("l_quantity").alias("input"),
        F.when(F.col("l_returnflag") == "R", F.least(F.col("l_linenumber").cast("double"), F.col("l_quantity"))).otherwise(F.lit(0.0)).alias("ng_qty"),
        F.concat("p_brand", F.lit("_"), line).alias("line_shift"),
        F.col("l_suppkey").alias("supplier"),
        F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 10, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyyMMdd")).alias("rid"),
    )


#: The order priorities, which stand for process names.
PROCESSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _arrivals(rows: DataFrame, *arrivals) -> DataFrame:
    """``rows`` as they arrived: (number, columns, condition) of each arrival, told apart by ``rid``."""
    each = [F.when(F.expr(condition), F.struct(F.lit(n).alias("n"), *[c.alias(k) for k, c in columns.items()])) for n, columns, condition in arrivals]
    return rows.select("*", F.explode(F.array(*each)).alias("_a")).where("_a is not null")


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, material, code, process, process_type as they arrived.

    Processes that start with 5 have none, nor has one code of one material. Two codes arrive again with the name in
    quotes and another type, and once more under the plain name with a third.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("material"), F.concat(F.lit("P"), (F.col("p_size") % 10).cast("string")).alias("code")).distinct()
    keys = parts.select("*", F.explode(F.array(*map(F.lit, PROCESSES[:4]))).alias("process")).where("not (material = 'Brand#11' and code = 'P1')")
    first = F.substring("process", 1, 1)
    kind = F.when(first == "1", "SUB").when(first == "2", "MAIN").when(first == "3", "FUNCTION").otherwise("VISUAL")
    again = "code in ('P2', 'P3')"
    rows = _arrivals(
        keys,
        (1, {"name": F.col("process"), "type": kind}, "true"),
        (2, {"name": F.concat(F.lit("'"), "process", F.lit("  ")), "type": F.lit("VISUAL")}, again),
        (3, {"name": F.col("process"), "type": F.lit("FUNCTION")}, again),
    )
    rid = F.concat_ws("-", F.col("_a.n").cast("string"), "material", "code", "process")
    return rows.select(rid.alias("rid"), "material", "code", F.col("_a.name").alias("process"), F.col("_a.type").alias("process_type"))


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, process, ng, reason as they arrived.

    One defect name has none. Names of even length arrive again in lower case with another reason, the others once
    more as they are.
    """
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("ng")).distinct().where("ng <> 'STANDARD'")
    keys = names.select("ng", F.explode(F.array(*map(F.lit, PROCESSES))).alias("process"))
    rows = _arrivals(
        keys,
        (1, {"process": F.col("process"), "ng": F.col("ng"), "reason": F.concat(F.lit("R"), (F.length("ng") % 3).cast("string"))}, "true"),
        (2, {"process": F.lower("process"), "ng": F.lower("ng"), "reason": F.lit("CASE")}, "length(ng) % 2 = 0"),
        (3, {"process": F.col("process"), "ng": F.col("ng"), "reason": F.lit("LAST")}, "length(ng) % 2 = 1"),
    )
    return rows.select(F.concat_ws("-", F.col("_a.n").cast("string"), "process", "ng").alias("rid"), "_a.process", "_a.ng", "_a.reason")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised measurements, a row for each defect kind of a checked lot: rid, dataset, variable, variable_group,
    variable_detail, line, check_type, input, ok, ng_total, defect_type, defect_count, ng_rate."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.when((o % 17 == 0) & (n == 1), "__ALIGN_ERROR__").when(o % 7 == 0, "").when(o % 19 == 0, "Wire Moving NG").when(n % 3 == 0, " ").otherwise(F.concat(F.lit("D"), n.cast("string")))
    total = (o % 13).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lpad(o.cast("string"), 10, "0"), *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyyMMdd")).alias("rid"),
        F.concat(F.lit("S"), (o % 100).cast("string")).alias("dataset"),
        F.concat(F.lit("V"), o.cast("string")).alias("variable"),
        F.when(o % 2 == 0, "normal").otherwise("test").alias("variable_group"),
        F.concat(F.lit("part "), (n % 2).cast("string")).alias("variable_detail"),
        F.concat(F.lit("L"), (o % 3).cast("string")).alias("line"),
        F.col("l_linestatus").alias("check_type"),
        F.when(o % 11 == 0, 0).otherwise(100 + (o % 5).cast("int")).alias("input"),
        F.when(o % 11 == 0, 0).otherwise(90).alias("ok"),
        total.alias("ng_total"),
        kind.alias("defect_type"),
        F.when(o % 5 == 0, 0).otherwise(n.cast("int")).alias("defect_count"),
        (total / 100.0).alias("ng_rate"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier, grp: its region and its nation, for suppliers of nations with an even number."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 2 = 0")
    return rows.select(F.col("s_suppkey").alias("supplier"), F.explode(F.array("r_name", F.concat("r_name", F.lit(" / "), "n_name"))).alias("grp"))


SQL = {
    "facts": """facts AS (SELECT p_brand AS material, 'L' || (l_suppkey % 5) AS line, 'P' || (p_size % 10) AS code, o_orderpriority AS process,
      p_type AS ng, 'N' || (p_size % 7) AS ng_code, l_linestatus AS shift, CAST(l_shipdate AS DATE) AS day, l_quantity AS input,
      CASE WHEN l_returnflag = 'R' THEN least(CAST(l_linenumber AS DOUBLE), l_quantity) ELSE 0.0::DOUBLE END AS ng_qty,
      p_brand || '_L' || (l_suppkey % 5) AS line_shift, l_suppkey AS supplier,
      lpad(l_orderkey::VARCHAR, 10, '0') || '-' || lpad(l_linenumber::VARCHAR, 10, '0') || '-' || lpad(l_partkey::VARCHAR, 10, '0') || '-' || lpad(l_suppkey::VARCHAR, 10, '0') || '-' || strftime(l_shipdate, '%Y%m%d') AS rid
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "routing": """routing AS (SELECT n || '-' || material || '-' || code || '-' || process AS rid, material, code,
      CASE n WHEN 2 THEN chr(39) || process || '  ' ELSE process END AS process,
      CASE n WHEN 2 THEN 'VISUAL' WHEN 3 THEN 'FUNCTION' ELSE CASE left(process, 1) WHEN '1' THEN 'SUB' WHEN '2' THEN 'MAIN' WHEN '3' THEN 'FUNCTION' ELSE 'VISUAL' END END AS process_type
      FROM (SELECT DISTINCT p_brand AS material, 'P' || (p_size % 10) AS code FROM part), unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED']) p(process), unnest([1, 2, 3]) a(n)
      WHERE NOT (material = 'Brand#11' AND code = 'P1') AND (n = 1 OR code IN ('P2', 'P3')))""",
    "reasons": """reasons AS (SELECT n || '-' || process || '-' || ng AS rid, CASE n WHEN 2 THEN lower(process) ELSE process END AS process, CASE n WHEN 2 THEN lower(ng) ELSE ng END AS ng,
      CASE n WHEN 2 THEN 'CASE' WHEN 3 THEN 'LAST' ELSE 'R' || (length(ng) % 3) END AS reason
      FROM (SELECT DISTINCT p_type AS ng FROM part WHERE p_type <> 'STANDARD'), unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) p(process), unnest([1, 2, 3]) a(n)
      WHERE n = 1 OR length(ng) % 2 = n - 2)""",
    "reason_of": """reason_of AS (SELECT lower(process) AS p, lower(ng) AS n, arg_min(reason, rid) AS reason FROM reasons GROUP BY ALL)""",
    "measurements": """measurements AS (SELECT lpad(l_orderkey::VARCHAR, 10, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS rid,
      'S' || (l_orderkey % 100) AS dataset, 'V' || l_orderkey AS variable, CASE WHEN l_orderkey % 2 = 0 THEN 'normal' ELSE 'test' END AS variable_group, 'part ' || (l_linenumber % 2) AS variable_detail,
      'L' || (l_orderkey % 3) AS line, l_linestatus AS check_type, CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE 100 + l_orderkey % 5 END::INTEGER AS input, CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE 90 END AS ok,
      (l_orderkey % 13)::INTEGER AS ng_total, CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 1 THEN '__ALIGN_ERROR__' WHEN l_orderkey % 7 = 0 THEN '' WHEN l_orderkey % 19 = 0 THEN 'Wire Moving NG'
      WHEN l_linenumber % 3 = 0 THEN ' ' ELSE 'D' || l_linenumber END AS defect_type, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_linenumber END::INTEGER AS defect_count, (l_orderkey % 13) / 100.0::DOUBLE AS ng_rate FROM lineitem)""",
    "members": """members AS (SELECT s_suppkey AS supplier, unnest([r_name, r_name || ' / ' || n_name]) AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)""",
    "by_grain": """by_grain AS (SELECT f.*, k.kind, k.key FROM facts f, LATERAL (SELECT 'D' AS kind, strftime(day, '%Y%m%d') AS key UNION ALL
      SELECT 'W', year(day) || lpad(CAST((dayofyear(day) - 1 + isodow(date_trunc('year', day)::DATE) - 1) // 7 + 1 AS VARCHAR), 2, '0') UNION ALL SELECT 'M', strftime(day, '%Y%m')) k)""",
}


def with_tables(*names: str, sql: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + (", " if sql.lstrip().upper().startswith("WITH ") else " ") + (sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else sql)


#: ``text.normalize`` of a name without quotation marks of other kinds than these.
NORMAL = "trim(regexp_replace(translate(replace(replace({}, '[', ''), ']', '_'), chr(39) || chr(34) || '~+' || chr(13) || chr(10), '      '), '\\s{{2,}}', ' ', 'g'))"
PPM = "CASE WHEN sum(input) > 0 THEN round_even(sum(ng_qty) / sum(input) * 1e6, 0) ELSE 0.0 END"
