"""Named queries over nested, stored and streamed structures, files and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.operators import classifier, enrich, hulls, intervals, learning, trees
from gaugeworks.plans.binding import NORMAL, table
from gaugeworks.plans.catalog import query, rounded, values
from gaugeworks.plans.further import NAMED, OWN, asked, name_rows, predicted
from gaugeworks.sources import files, many, stored, writers
from gaugeworks.streaming import refetch

# --- trees ---------------------------------------------------------------------------------------------------------

PATHS = ("", "big", "big\x1fk1\x1fdeep", "big\x1fk2", "small\x1fk1", "big\x1fk1\x1f", "\x1fend")
#: Of every nine members: paths of up to three levels whose nodes in between have no row, blank materials and shifts.
TREE_ITEMS = f"""items AS (
  SELECT r_name AS grp, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS material,
    CASE s_suppkey % 8 {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS))} END AS path,
    CASE WHEN s_suppkey % 9 = 1 THEN NULL ELSE n_name || '_' || s_suppkey END AS line_shift, lpad(s_suppkey::VARCHAR, 10, '0') AS rid
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def tree_items(s, d):
    rows = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows, key, path = rows.join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("s_suppkey"), F.lit(None).cast("string")
    for i, p in enumerate(PATHS):
        path = F.when(key % 8 == i, p).otherwise(path)
    shift = F.when(key % 9 != 1, F.concat("n_name", F.lit("_"), key.cast("string")))
    material = F.when(key % 3 == 0, "").otherwise(F.col("n_name"))
    return rows.select(F.col("r_name").alias("grp"), material.alias("material"), path.alias("path"), shift.alias("line_shift"), F.lpad(key.cast("string"), 10, "0").alias("rid"))


query("rs07_nested_tree", f"""
WITH RECURSIVE {TREE_ITEMS},
named AS (SELECT grp, coalesce({OWN.replace('line_shift', "coalesce(line_shift, '')")}, '') AS m, split(coalesce(path, ''), chr(31)) AS whole, coalesce(line_shift, '') AS ls, rid FROM items),
nodes AS (
  SELECT grp, m, whole[:d] AS p, d, min(rid) AS first, coalesce(list(ls ORDER BY rid) FILTER (d = len(whole) AND ls <> ''), []) AS shifts
  FROM named, LATERAL (SELECT unnest(range(1, len(whole) + 1)) AS d) GROUP BY ALL),
up(d, grp, m, p, first, body) AS (
  SELECT max(d) + 1, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM nodes
  UNION ALL
  SELECT n.d, n.grp, n.m, n.p, n.first,
    rtrim(to_json({{'name': n.p[-1], 'line_shifts': n.shifts}})::VARCHAR, '}}') || ',"sub_groups":[' || coalesce(c.children, '') || ']}}'
  FROM (SELECT min(d) - 1 AS d FROM up) t JOIN nodes n ON n.d = t.d
  LEFT JOIN (SELECT grp, m, p[:len(p) - 1] AS p, string_agg(body, ',' ORDER BY first) AS children FROM up GROUP BY ALL) c ON c.grp = n.grp AND c.m = n.m AND c.p = n.p),
materials AS (
  SELECT grp, min(first) AS first, rtrim(to_json({{'material': m}})::VARCHAR, '}}') || ',"sub_groups":[' || string_agg(body, ',' ORDER BY first) || ']}}' AS body
  FROM up WHERE len(p) = 1 GROUP BY grp, m)
SELECT grp, '[' || string_agg(body, ',' ORDER BY first) || ']' AS tree FROM materials GROUP BY grp""")(
    lambda s, d: trees.nested_tree(tree_items(s, d))
)

# --- look-ups by the rules of merges ---------------------------------------------------------------------------------

#: Keys of two parts, one of them null or empty now and then, on both sides.
KEYED = "CASE WHEN {k} % 5 = 0 THEN NULL WHEN {k} % 5 = 1 THEN '' ELSE ({k} % 40)::VARCHAR END"


def keyed(k):
    return F.when(k % 5 == 0, None).when(k % 5 == 1, "").otherwise((k % 40).cast("string"))


query("jn05_null_keys", f"""
WITH c AS (SELECT c_custkey, {KEYED.format(k='c_custkey')} AS a, c_nationkey % 4 AS b, c_mktsegment AS tag FROM customer),
o AS (SELECT {KEYED.format(k='o_orderkey')} AS a, (o_custkey % 3)::INTEGER AS b, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS tag FROM orders)
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM o WHERE coalesce(o.a, '') = coalesce(c.a, '') AND o.b = c.b)
  THEN (SELECT max(o.tag) FROM o WHERE coalesce(o.a, '') = coalesce(c.a, '') AND o.b = c.b) ELSE tag END AS tag FROM c""")(
    lambda s, d: enrich.update_from(
        table(s, d, "customer").select("c_custkey", keyed(F.col("c_custkey")).alias("a"), (F.col("c_nationkey") % 4).alias("b"), F.col("c_mktsegment").alias("tag")),
        table(s, d, "orders").select(keyed(F.col("o_orderkey")).alias("a"), (F.col("o_custkey") % 3).alias("b"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("tag")),
        ["a", "b"], "tag",
    ).select("c_custkey", "tag")
)

#: Raw routing rows as they arrive: names in quotes and with doubled spaces, some blank, each key several times.
RAW_ROUTING = """raw AS (
  SELECT ' ' || p_brand AS model, CASE WHEN p_size % 11 = 0 THEN ' ' ELSE 'P' || (p_size % 10) || chr(10) END AS code,
    CASE WHEN p_size % 13 = 0 THEN NULL ELSE chr(39) || replace(p_type, ' ', '  ') || '~' END AS name,
    CASE p_size % 5 WHEN 0 THEN 'Main Assy' WHEN 1 THEN 'Sub Assy' WHEN 2 THEN 'Final Visual' WHEN 3 THEN 'Function' ELSE 'Other' END AS kind, lpad(p_partkey::VARCHAR, 10, '0') AS rid FROM part)"""


def raw_routing(s, d):
    size, kind = F.col("p_size"), F.lit("Other")
    for i, k in enumerate(("Main Assy", "Sub Assy", "Final Visual", "Function")):
        kind = F.when(size % 5 == i, k).otherwise(kind)
    return table(s, d, "part").select(
        F.concat(F.lit(" "), "p_brand").alias("model"),
        F.when(size % 11 == 0, " ").otherwise(F.concat(F.lit("P"), (size % 10).cast("string"), F.lit("\n"))).alias("code"),
        F.when(size % 13 != 0, F.concat(F.lit("'"), F.replace("p_type", F.lit(" "), F.lit("  ")), F.lit("~"))).alias("name"),
        text.process_type(kind).alias("process_type"), F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("rid"),
    )


query("jn09_merge_routing", f"""
WITH {RAW_ROUTING},
old AS (SELECT DISTINCT p_brand AS model, 'P' || (p_size % 10) AS code, lower(p_type) || '' AS name, 'KEPT' AS process_type FROM part WHERE p_size % 2 = 0 UNION ALL
  SELECT DISTINCT p_brand, 'P' || (p_size % 10), p_type, 'KEPT' FROM part WHERE p_size % 4 = 0),
n AS (SELECT {NORMAL.format('model')} AS model, {NORMAL.format('code')} AS code, {NORMAL.format("coalesce(name, '')")} AS name,
    CASE kind WHEN 'Main Assy' THEN 'MAIN' WHEN 'Sub Assy' THEN 'SUB' WHEN 'Final Visual' THEN 'VISUAL' WHEN 'Function' THEN 'FUNCTION' ELSE kind END AS process_type, rid FROM raw)
SELECT * FROM old UNION ALL
SELECT model, code, name, arg_min(process_type, rid) FROM n WHERE model <> '' AND code <> '' AND name <> ''
  AND NOT EXISTS (SELECT 1 FROM old WHERE old.model = n.model AND old.code = n.code AND old.name = n.name) GROUP BY model, code, name""")(
    lambda s, d: enrich.insert_missing(
        stored_routing(s, d, 2, F.lower("p_type")).unionByName(stored_routing(s, d, 4, F.col("p_type"))), raw_routing(s, d), ["model", "code", "name"], ("model", "code", "name")
    )
)


def stored_routing(s, d, part, name):
    code = F.concat(F.lit("P"), (F.col("p_size") % 10).cast("string"))
    return table(s, d, "part").where(F.col("p_size") % part == 0).select(F.col("p_brand").alias("model"), code.alias("code"), name.alias("name"), F.lit("KEPT").alias("process_type")).distinct()


#: Ways to write a day that only the general parse takes, the pattern each begins with and what follows; the last fail.
GENERAL = (
    ("yyyy-MM-dd", "T12:30:00"), ("yyyy-MM-dd", " 23:59"), ("yyyy/M/d", " 7:05:09.25"), ("M/d/yyyy", ""), ("MM/dd/yyyy", " 11:00 pm"), ("MMMM d, yyyy", ""),
    ("d MMM yyyy", " 01:02"), ("E, dd MMM yyyy", " 12:00:00 GMT"), ("yyyy-MM-dd", "T12:00:00.1234567Z"), ("yyyy-M-d", ""), ("yyyy-MM-dd", " 25:00"), ("M/d/yyyy", " 13:00 PM"),
)


def general_dates(s, d):
    day, n, found = F.to_date("o_orderdate"), F.col("o_orderkey") % len(GENERAL), F.lit(None).cast("string")
    for i, (form, rest) in enumerate(GENERAL):
        found = F.when(n == i, F.concat(F.lit(" "), F.date_format(day, form), F.lit(rest))).otherwise(found)
    return table(s, d, "orders").select("o_orderkey", found.alias("t"))


query("fn07_general_dates", f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(GENERAL)} < {len(GENERAL) - 2} THEN CAST(o_orderdate AS DATE) END AS day FROM orders")(
    lambda s, d: general_dates(s, d).select("o_orderkey", text.parse_date(F.col("t"), 2024).alias("day"))
)

# --- files -----------------------------------------------------------------------------------------------------------


def page_files(s, d):
    """A folder with a file for each page's html, and for every third page a second one."""
    path = writers.scratch(s, "pages")
    rows = table(s, d, "pages").select(F.col("html").alias("value"), "page_id", F.explode(F.when(F.col("page_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    place = F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/copy="), F.col("copy").cast("string"), F.lit("/page.txt"))
    files.write_each(rows.select(place.alias("place"), "value"), path)
    return path


PAGE_FILES = """f AS (
  SELECT page_id, copy, coalesce(html, '') || chr(10) AS body, hex(encode(coalesce(html, '') || chr(10))) AS h FROM pages, LATERAL (SELECT unnest(CASE WHEN page_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS copy)),
ends AS (SELECT *, strlen(body) AS bytes, greatest(1, ceil(strlen(body) * 0.1::DOUBLE))::BIGINT AS n FROM f)"""


def page_of():
    """The page and copy that a file's path names."""
    return [F.regexp_extract("path", f"/{n}=([0-9]+)/", 1).cast("long").alias(n) for n in ("page_id", "copy")]


@query("src23_file_index", f"""
WITH {PAGE_FILES}
SELECT page_id, copy::BIGINT AS copy, bytes, upper(sha256(unhex(CASE WHEN 2 * n >= bytes THEN h ELSE left(h, 2 * n) || right(h, 2 * n) END))) AS hash, copy = 0 AS reused FROM ends""")
def _(s, d):
    path = page_files(s, d)
    first = files.file_index(s, path).where(F.contains("path", F.lit("copy=0")))
    return files.file_index(s, path, first).select(*page_of(), "bytes", "hash", "reused")


@query("jn17_same_files_on_disk", f"""
WITH {PAGE_FILES}, g AS (SELECT body, min('page_id=' || page_id || '/copy=' || copy) AS first_path, count(*) AS copies FROM f GROUP BY body HAVING count(*) > 1)
SELECT page_id, copy::BIGINT AS copy, strlen(body) AS bytes, upper(sha256(body)) AS hash, first_path, copies FROM f JOIN g USING (body)""")
def _(s, d):
    same = files.same_files(files.file_index(s, page_files(s, d)))
    return same.select(*page_of(), "bytes", "hash", F.regexp_extract("first_path", "page_id=[0-9]+/copy=[0-9]+", 0).alias("first_path"), "copies")


SEPARATORS = (";", "\t", ",", " ", "|")
HEADS = ("Key;name;;NAME", "Key\tname\t\tNAME", "Key,name,,NAME", "Key name Column NAME", "Key|name||NAME")


def customer_files(s, d):
    """Five files of customers, each with another delimiter; names hold spaces but in the file that spaces cut."""
    path, k, key = writers.scratch(s, "customers"), F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    lines = F.lit(None).cast("string")
    for i, sep in enumerate(SEPARATORS):
        name = F.concat("c_name", F.lit("_" if sep == " " else " "), "c_mktsegment")
        own = F.concat_ws(sep, key, name, F.lit("-" if sep == " " else ""), F.concat(F.lit(" "), F.col("c_nationkey").cast("string")))
        lines = F.when(k == i, own).otherwise(lines)
    rows = table(s, d, "customer").select(k.cast("int").alias("no"), F.lit(1).alias("place"), lines.alias("value"))
    heads = s.createDataFrame([(i, 0, h) for i, h in enumerate(HEADS)], "no int, place int, value string")
    rows.unionByName(heads).repartition(len(SEPARATORS), "no").sortWithinPartitions("no", "place").drop("place").write.partitionBy("no").text(path)
    return path



def file_no():
    return F.regexp_extract("file", "/no=([0-9]+)/", 1).cast("int").alias("no")


query("src15_delimiter", "SELECT DISTINCT (c_custkey % 5)::INTEGER AS no, [';', chr(9), ',', ' ', '|'][c_custkey % 5 + 1] AS delimiter FROM customer")(
    lambda s, d: many.headers(s, customer_files(s, d)).select(file_no(), "delimiter")
)
query("src16_unique_headers", """SELECT DISTINCT (c_custkey % 5)::INTEGER AS no, p::INTEGER AS place, ['Key', 'name', 'Column', 'NAME_2'][p + 1] AS name FROM customer, range(4) t(p)""")(
    lambda s, d: many.headers(s, customer_files(s, d)).select(file_no(), F.posexplode("names").alias("place", "name"))
)
query("src17_many_files", """SELECT (c_custkey % 5)::INTEGER AS no, c_custkey::VARCHAR AS k, c_name || CASE WHEN c_custkey % 5 = 3 THEN '_' ELSE ' ' END || c_mktsegment AS name,
  CASE WHEN c_custkey % 5 = 3 THEN '-' ELSE '' END AS filler, c_nationkey::VARCHAR AS nation FROM customer""")(
    lambda s, d: many.delimited_files(s, customer_files(s, d)).select(
        file_no(), many.value_of("Key").alias("k"), many.value_of("name").alias("name"), many.value_of("Column").alias("filler"), many.value_of("NAME_2").alias("nation")
    )
)

# --- streams ---------------------------------------------------------------------------------------------------------

#: Days of January 2024 on which events are fetched, each time the last seven days; an event is seen some days late.
FETCHES, WINDOW, LAG = (8, 11, 17, 30), 7, 5


@query("src06_set01_refetch", f"""
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, day(ts) AS n, event_id % {LAG} AS lag FROM events WHERE month(ts) = 1 AND year(ts) = 2024),
k AS (SELECT unnest({list(FETCHES)}) AS f),
seen AS (SELECT e.*, f FROM e JOIN k ON n <= f AND n > f - {WINDOW} AND n + lag <= f),
chosen AS (SELECT n, coalesce(max(f) FILTER (n > f - 3), min(f)) AS f FROM (SELECT DISTINCT n, f FROM seen) GROUP BY n)
SELECT event_id, day FROM seen JOIN chosen USING (n, f)""")
def _(s, d):
    arriving, path, checkpoint = (writers.scratch(s, n) for n in ("fetches", "days", "progress"))
    events = table(s, d, "events").select("event_id", F.to_date("ts").alias("day"), F.date_add(F.to_date("ts"), (F.col("event_id") % LAG).cast("int")).alias("known"))
    for at in FETCHES:
        today = F.lit(f"2024-01-{at:02}").cast("date")
        part = events.where((F.col("day") <= today) & (F.col("day") > F.date_sub(today, WINDOW)) & (F.col("day") >= "2024-01-01") & (F.col("known") <= today))
        part.select("event_id", "day", today.alias("fetched")).coalesce(1).write.mode("append").parquet(arriving)
        fetches = s.readStream.schema("event_id bigint, day date, fetched date").parquet(arriving)
        refetch.follow(fetches, path, checkpoint).awaitTermination()  # each run takes the fetch that has come since
    return s.read.schema("event_id bigint, day date").parquet(path)

# --- intervals and hulls -----------------------------------------------------------------------------------------------

#: Orders last up to a month, some for over a year; errors of a user, brought to the orders' years, up to three days.
query("flt09_overlapping_pairs", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + (o_orderkey % 30 + CASE WHEN o_orderkey % 500 = 0 THEN 400 ELSE 0 END)::INTEGER AS last_day FROM orders),
e AS (SELECT event_id, CAST(ts AS DATE) - 9000 AS first_day, CAST(ts AS DATE) - 9000 + (event_id % 3)::INTEGER AS last_day FROM events WHERE event_type = 'error')
SELECT o_orderkey, count(*) AS events, min(event_id) AS lowest FROM o JOIN e ON o.last_day >= e.first_day AND o.first_day <= e.last_day GROUP BY o_orderkey""")(
    lambda s, d: intervals.overlap_totals(*spans(s, d), 4, "event_id").select("o_orderkey", F.col("n").alias("events"), "lowest")
)


def spans(s, d):
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    orders = table(s, d, "orders").select("o_orderkey", F.unix_date(day).alias("first"), (F.unix_date(day) + key % 30 + F.when(key % 500 == 0, 400).otherwise(0)).alias("last"))
    start = F.unix_date(F.to_date("ts")) - 9000
    events = table(s, d, "events").where("event_type = 'error'").select("event_id", start.alias("first"), (start + F.col("event_id") % 3).alias("last"))
    span = (F.col("first"), F.col("last"))
    return orders, events, span, span


#: Each chain goes on to the point with the least (lower) or greatest (upper) slope, and of these to the farthest.
query("st23_convex_hull", """
WITH RECURSIVE p AS (SELECT DISTINCT event_type AS name, round(epoch_us(ts) / 1e6 / 86400, 8) AS x, round(value, 8) AS y FROM events),
low(name, x, y, n) AS (
  SELECT name, min(x), arg_min(y, (x, y)), 0 FROM p GROUP BY name
  UNION ALL SELECT l.name, (arg_min({'x': p.x, 'y': p.y}, ((p.y - l.y) / (p.x - l.x), -p.x))).x, (arg_min({'x': p.x, 'y': p.y}, ((p.y - l.y) / (p.x - l.x), -p.x))).y, l.n + 1
  FROM low l JOIN p ON p.name = l.name AND p.x > l.x GROUP BY l.name, l.n),
top(name, x, y, n) AS (
  SELECT name, max(x), arg_max(y, (x, y)), 0 FROM p GROUP BY name
  UNION ALL SELECT l.name, (arg_min({'x': p.x, 'y': p.y}, ((p.y - l.y) / (p.x - l.x), p.x))).x, (arg_min({'x': p.x, 'y': p.y}, ((p.y - l.y) / (p.x - l.x), p.x))).y, l.n + 1
  FROM top l JOIN p ON p.name = l.name AND p.x < l.x GROUP BY l.name, l.n),
corners AS (SELECT name, x, y, n, 0 AS side FROM low UNION SELECT name, x, y, n, 1 FROM top),
once AS (SELECT name, x, y, min((side, n)) AS place FROM corners GROUP BY name, x, y)
SELECT name, (row_number() OVER (PARTITION BY name ORDER BY place) - 1)::INTEGER AS corner, x, y FROM once""")(
    lambda s, d: hulls.convex_hull(values(s, d), "name")
)

# --- stored tables -----------------------------------------------------------------------------------------------------

CUSTOMERS = "c_custkey bigint, seg string, seq bigint"


def stored_customers(s, d):
    path = writers.scratch(s, "customers")
    stored.create(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.lit(0).cast("long").alias("seq")), path, ["c_custkey"], 16)
    return path


@query("snk06_stored_upsert", """
SELECT coalesce(c_custkey, o_custkey) AS c_custkey, coalesce(seg, c_mktsegment) AS seg, coalesce(seq, 0) AS seq FROM customer
FULL JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS seg, max(o_orderkey) AS seq FROM (SELECT o_custkey + 100 AS o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_custkey % 50 < 3) GROUP BY o_custkey) ON o_custkey = c_custkey""")
def _(s, d):
    path = stored_customers(s, d)
    new = table(s, d, "orders").where("o_custkey % 50 < 3").select((F.col("o_custkey") + 100).alias("c_custkey"), F.col("o_orderpriority").alias("seg"), F.col("o_orderkey").alias("seq"))
    stored.upsert(s, path, new, CUSTOMERS, ["c_custkey"], "seq", 16)
    return stored.read(s, path, CUSTOMERS)


@query("snk08_stored_replace", """
SELECT c_custkey, c_mktsegment AS seg, 0::BIGINT AS seq FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 40 = 1)
UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_custkey % 40 = 1""")
def _(s, d):
    path = stored_customers(s, d)
    new = table(s, d, "orders").where("o_custkey % 40 = 1").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("seg"), F.col("o_orderkey").alias("seq"))
    stored.replace_on_key(s, path, new, CUSTOMERS, ["c_custkey"], 16)
    return stored.read(s, path, CUSTOMERS)


#: Base rows, and two batches of feedback that correct some labels and bring others.
RETRAINED = f"""{NAMED.split('t AS')[0]}
t AS (SELECT p_type, name, '0' || rid AS rid FROM n UNION ALL SELECT 'FIXED', name, '1' || rid FROM n WHERE p_size % 7 = 0 UNION ALL SELECT 'Promo', name, '2' || rid FROM n WHERE p_size % 11 = 0)"""


def taught(s, d):
    """The path of what a base and two batches taught, each merged into what was stored before."""
    path, rows = writers.scratch(s, "taught"), name_rows(s, d)
    learning.start(rows, path, ("name",), "p_type", 16)
    for batch, part, label in ((1, "p_size % 7 = 0", "FIXED"), (2, "p_size % 11 = 0", "Promo")):
        learning.learn(rows.where(part).withColumn("p_type", F.lit(label)), path, ("name",), "p_type", batch, 16)
    return path


query("ml05_taught_look_ups", f"WITH {RETRAINED} SELECT n.name, arg_max(t.p_type, t.rid) AS p_type FROM (SELECT DISTINCT name FROM n) n JOIN t ON lower(trim(t.name)) = lower(trim(n.name)) GROUP BY n.name")(
    lambda s, d: classifier.looked_up(name_rows(s, d), learning.model(s, taught(s, d), ("name",), "p_type", "last"))
)
# counts are by labels regardless of case, which are written as they first came
query("ml05_taught_predictions", predicted("arg_min", 0.55, "").replace(NAMED, RETRAINED.replace("'Promo'", "'PROMO'")))(
    lambda s, d: rounded(classifier.predict(asked(s, d), learning.model(s, taught(s, d), ("name",), "p_type")), "confidence")
)
