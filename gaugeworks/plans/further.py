"""More named queries: report shapes, classifier, validation, statistics with guards, and readers and writers of text files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions import measures, periods, text
from gaugeworks.operators import classifier, datasets, enrich, quality, ranking, rates, reports
from gaugeworks.plans.binding import NORMAL, PPM, facts, measurements, members, reasons, table
from gaugeworks.plans.catalog import LIMITS, NAME, REASONED, ROUTE, ROUTES, TOKENS, noisy_name, query, r6, rounded, routed, values
from gaugeworks.sources import readers, writers

# --- reports -------------------------------------------------------------------------------------------------------

DEFECT = ["process_type", "process", "ng"]
DETAIL = f"""WITH {ROUTES}, gr AS (SELECT f.*, coalesce(e.pt, l.pt, '') AS process_type, coalesce(m.grp, f.line_shift) AS grp FROM by_grain f {ROUTE} LEFT JOIN members m USING (supplier))"""
REASON_ROWS = f"""WITH {ROUTES}, gr AS (SELECT f.*, coalesce(e.pt, l.pt, '') AS process_type, coalesce(r.reason, '') AS reason FROM by_grain f {ROUTE} {REASONED})"""


def daily(s, d):
    """Quantities of every defect by group and day."""
    return rates.quantities(enrich.expand_groups(routed(s, d), members(s, d)), [*DEFECT, "grp", "day"])


def detail(s, d, kinds="DWM"):
    """Quantities of every defect by group and period, for reports that use them once."""
    return periods.by_grain(daily(s, d), kinds=kinds)


def detail_kept(s, d, kinds):
    """The same from daily sums that are written once, for reports that use them several times."""
    return periods.by_grain(writers.staged(daily(s, d), "daily"), kinds=kinds)


def reasoned(s, d, kinds="W"):
    """Quantities of every defect by reason and period, from daily sums that are written once."""
    rows = rates.quantities(enrich.reason(routed(s, d), reasons(s, d)), ["reason", *DEFECT, "day"])
    return periods.by_grain(writers.staged(rows, "daily"), kinds=kinds)


def period_key(kind, offset, rows="gr"):
    return f"(SELECT min(key) FROM (SELECT DISTINCT key FROM {rows} WHERE kind = '{kind}' ORDER BY key DESC LIMIT {offset + 1}))"


COLUMNS = [("D", "19980802"), ("D", "19980801"), ("W", "199831"), ("W", "199830"), ("M", "199808"), ("M", "199807")]


def cell(kind, key, value, where="", none="0.0"):
    return f"coalesce(max({value}) FILTER (kind = '{kind}' AND key = '{key}'{where}), {none})"


def pivoted(value, separators=True):
    found, before = [], None
    for kind, key in COLUMNS:
        if separators and before not in (None, kind):
            found.append(f"NULL::VARCHAR AS sep_{kind}")
        before = kind
        found.append(f"{cell(kind, key, value)} AS {kind}{key}")
    return ", ".join(found)


CHOSEN = "(kind, key) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in COLUMNS) + ")"
query("rs01_pivot", f"{DETAIL} SELECT process, ng, {pivoted('p')} FROM (SELECT process, ng, kind, key, {PPM} AS p FROM gr WHERE {CHOSEN} GROUP BY ALL) GROUP BY process, ng", "facts routing members by_grain")(
    lambda s, d: reports.period_pivot(rates.combo_ppm(detail(s, d), ["process", "ng", "kind", "key"]), ["process", "ng"], COLUMNS, {"ppm": F.col("ppm")})
)


@query("rs01_newest_periods", f"WITH k AS (SELECT kind, key FROM (SELECT DISTINCT kind, key FROM by_grain) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY key DESC) <= CASE kind WHEN 'D' THEN 3 ELSE 2 END) SELECT kind, key, {PPM} AS ppm FROM by_grain SEMI JOIN k USING (kind, key) GROUP BY ALL", "facts by_grain")
def _(s, d):
    rows = rates.combo_ppm(periods.by_grain(rates.quantities(facts(s, d), ["day"])), ["kind", "key"])
    newest = reports.newest_periods(rows, {"D": 3, "W": 2, "M": 2})
    return rows.where(F.struct("kind", "key").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in newest]))


@query("rs02_detail_pivot", f"""{DETAIL}, c AS (SELECT process_type, process, ng, grp, kind, key, {PPM} AS p FROM gr WHERE kind = 'M' AND grp IN ('ASIA', 'EUROPE') GROUP BY ALL),
  x AS (SELECT 1 AS place, 'TOTAL' AS process_type, '' AS process, '' AS ng, grp, kind, key, sum(p) AS p FROM c GROUP BY grp, kind, key UNION ALL SELECT 2, process_type, '', '', grp, kind, key, sum(p) FROM c GROUP BY ALL
  UNION ALL SELECT 3, process_type, process, ng, grp, kind, key, p FROM c)
  SELECT place, process_type, process, ng, {', '.join(cell('M', k, 'p', f" AND grp = '{g}'") + f' AS M{k}_{g}' for k in ('199807', '199806') for g in ('ASIA', 'EUROPE'))} FROM x GROUP BY place, process_type, process, ng""", "facts routing members by_grain")
def _(s, d):
    rows = detail(s, d, "M").where(F.col("grp").isin("ASIA", "EUROPE"))
    return reports.detail_pivot(rows, [("M", "199807"), ("M", "199806")], ["ASIA", "EUROPE"])


@query("rs03_all_groups", f"""{DETAIL} SELECT grp, process, ng, {', '.join(f"{cell('M', k, m)} AS M{k}_{n}" for k in ('199807', '199806') for m, n in (('i', 'input'), ('n', 'ng_qty'), ('p', 'ppm')))}
  FROM (SELECT grp, process, ng, kind, key, sum(input) AS i, sum(ng_qty) AS n, {PPM} AS p FROM gr WHERE kind = 'M' AND key IN ('199807', '199806') GROUP BY ALL) GROUP BY grp, process, ng""", "facts routing members by_grain")
def _(s, d):
    rows = rates.quantities(detail(s, d, "M"), ["grp", "process", "ng", "kind", "key"]).withColumn("ppm", measures.ppm(F.col("ng_qty"), F.col("input")))
    return reports.period_pivot(rows, ["grp", "process", "ng"], [("M", "199807"), ("M", "199806")], {m: F.col(m) for m in ("input", "ng_qty", "ppm")})


@query("rs04_aligned_headers", f"""{DETAIL}, x AS (SELECT 'asia' AS report, process, kind, key, {PPM} AS ppm FROM gr WHERE grp = 'ASIA' AND kind = 'W' GROUP BY ALL UNION ALL SELECT 'europe', process, kind, key, {PPM} FROM gr WHERE grp = 'EUROPE' AND kind = 'M' GROUP BY ALL)
  SELECT n.report, n.process, h.kind, h.key, coalesce(x.ppm, 0.0) AS ppm FROM (SELECT DISTINCT report, process FROM x) n CROSS JOIN (SELECT DISTINCT kind, key FROM x) h LEFT JOIN x ON x.report = n.report AND x.process = n.process AND x.kind = h.kind AND x.key = h.key""", "facts routing members by_grain")
def _(s, d):
    days = writers.staged(daily(s, d).where(F.col("grp").isin("ASIA", "EUROPE")), "daily")
    one = lambda group, kind: rates.combo_ppm(periods.by_grain(days.where(F.col("grp") == group), kinds=kind), ["process", "kind", "key"])
    return reports.aligned_headers({"asia": one("ASIA", "W"), "europe": one("EUROPE", "M")}, ["process"])


@query("wn05_worst_in_group", f"""{DETAIL}, t AS (SELECT process_type, process, ng, row_number() OVER (ORDER BY p DESC, process_type, process, ng)::INTEGER AS rank FROM
  (SELECT process_type, process, ng, {PPM} AS p FROM gr WHERE grp = 'ASIA' AND kind = 'W' AND key = {period_key('W', 1)} GROUP BY ALL) QUALIFY rank <= 10)
  SELECT rank, gr.process_type, gr.process, gr.ng, grp, kind, key, {PPM} AS ppm FROM gr JOIN t USING (process_type, process, ng) WHERE kind = 'W' GROUP BY ALL""", "facts routing members by_grain")
def _(s, d):
    rows = detail_kept(s, d, "W")
    return reports.over_groups(reports.worst_defects(rows, "ASIA"), rows, DEFECT)


@query("wn05_clamped_offset", f"""{DETAIL} SELECT process_type, process, ng, p AS reference_ppm, row_number() OVER (ORDER BY p DESC, process_type, process, ng)::INTEGER AS rank FROM
  (SELECT process_type, process, ng, {PPM} AS p FROM gr WHERE grp = 'ASIA' AND kind = 'M' AND key = (SELECT min(key) FROM gr WHERE kind = 'M') GROUP BY ALL) QUALIFY rank <= 3""", "facts routing members by_grain")
def _(s, d):
    return reports.worst_defects(detail_kept(s, d, "M"), "ASIA", "M", 100_000, 3)


@query("wn06_worst_processes", f"""{DETAIL}, t AS (SELECT process_type, process, sum(p) AS reference_ppm, row_number() OVER (ORDER BY sum(p) DESC, process_type, process)::INTEGER AS rank FROM
  (SELECT process_type, process, ng, {PPM} AS p FROM gr WHERE grp = 'EUROPE' AND kind = 'M' AND key = {period_key('M', 2)} GROUP BY ALL) GROUP BY process_type, process QUALIFY rank <= 4)
  SELECT rank, process_type, process, grp, kind, key, sum(p) AS ppm FROM (SELECT rank, gr.process_type, gr.process, ng, grp, kind, key, {PPM} AS p FROM gr JOIN t USING (process_type, process) WHERE kind = 'M' GROUP BY ALL) GROUP BY ALL""", "facts routing members by_grain")
def _(s, d):
    rows = detail_kept(s, d, "M")
    return reports.over_groups(reports.worst_processes(rows, "EUROPE", "M", 2, 4), rows, ["process_type", "process"])


@query("wn07_worst_reasons", f"""{REASON_ROWS}, c AS (SELECT DISTINCT reason, process_type, process, ng FROM gr WHERE kind = 'W' AND key = {period_key('W', 0)} AND ng_qty > 0),
  x AS (SELECT reason, process_type, process, ng, {PPM} AS ppm FROM gr WHERE kind = 'W' AND key = {period_key('W', 1)} GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ppm DESC, process_type, process, ng)::INTEGER AS number FROM x SEMI JOIN c USING (reason, process_type, process, ng) QUALIFY number <= 5),
  t AS (SELECT reason, coalesce(total, 0.0) AS total_ppm, row_number() OVER (ORDER BY coalesce(total, 0.0) DESC, reason)::INTEGER AS reason_rank FROM (SELECT DISTINCT reason FROM x WHERE trim(reason) <> '' AND reason <> 'Unknown')
    LEFT JOIN (SELECT reason, sum(ppm) AS total FROM b GROUP BY 1) USING (reason) QUALIFY reason_rank <= 20)
  SELECT t.reason, t.total_ppm, t.reason_rank, n::INTEGER AS number, coalesce(process_type, '') AS process_type, coalesce(process, '') AS process, coalesce(ng, '') AS ng, ppm
  FROM t CROSS JOIN unnest([1, 2, 3, 4, 5]) u(n) LEFT JOIN b ON b.reason = t.reason AND b.number = n""", "facts routing reasons reason_of by_grain")
def _(s, d):
    return reports.worst_reasons(reasoned(s, d))


@query("wn04_worst_by_reason", f"""{REASON_ROWS}, f AS (SELECT reason, process_type, process, ng, coalesce(max(p) FILTER (here), 0.0) AS ppm FROM (SELECT reason, process_type, process, ng, key = {period_key('W', 1)} AS here, {PPM} AS p FROM gr WHERE kind = 'W' AND reason <> '' GROUP BY ALL) GROUP BY ALL),
  t AS (SELECT reason, sum(ppm) AS total_ppm, row_number() OVER (ORDER BY sum(ppm) DESC, reason)::INTEGER AS reason_rank FROM f GROUP BY 1)
  SELECT *, row_number() OVER (PARTITION BY reason ORDER BY ppm DESC, process_type, process, ng)::INTEGER AS rank FROM f JOIN t USING (reason) QUALIFY rank <= 10""", "facts routing reasons reason_of by_grain")
def _(s, d):
    return reports.worst_by_reason(reasoned(s, d))


RANK = "CASE process_type WHEN 'SUB' THEN 1 WHEN 'MAIN' THEN 2 WHEN 'FUNCTION' THEN 3 WHEN 'VISUAL' THEN 4 ELSE 5 END"
query("wn09_row_numbers", f"WITH {ROUTES}, k AS (SELECT DISTINCT coalesce(e.pt, l.pt, '') AS process_type, f.process, f.ng FROM facts f {ROUTE}) SELECT *, row_number() OVER (ORDER BY {RANK}, process, ng, process_type)::INTEGER AS no FROM k", "facts routing")(
    lambda s, d: reports.numbered(routed(s, d).select(*DEFECT).distinct(), DEFECT)
)
DAYS = ["1998-07-30", "1998-07-31", "1998-08-01"]
DAY_CELLS = lambda m: ", ".join(f"coalesce(sum({m}) FILTER (day = DATE '{x}'), 0)::BIGINT AS d{x.replace('-', '')}" for x in DAYS)
DAY_LIST = ", ".join(f"DATE '{x}'" for x in DAYS)
DAY_ROWS = f"WITH {ROUTES}, gr AS (SELECT f.*, coalesce(e.pt, l.pt, '') AS process_type, coalesce(m.grp, f.line_shift) AS grp FROM facts f {ROUTE} LEFT JOIN members m USING (supplier))"
for _name, _by, _m in (("ag12_input_quantity", ["process_type", "process", "grp"], "input"), ("ag13_ng_quantity", ["process_type", "process", "ng", "grp"], "ng_qty")):
    query(_name, f"{DAY_ROWS} SELECT {', '.join(_by)}, {DAY_CELLS(_m)} FROM gr WHERE day IN ({DAY_LIST}) AND {_m} > 0 GROUP BY ALL HAVING greatest({', '.join(f'd{x.replace("-", "")}' for x in DAYS)}) > 0", "facts routing members")(
        lambda s, d, by=_by, m=_m: reports.quantities_by_day(enrich.expand_groups(routed(s, d), members(s, d)), by, m, DAYS)
    )
query("ag16_preaggregated", f"{DAY_ROWS} SELECT process_type, process, ng, grp, day, sum(input) AS input, sum(ng_qty) AS ng_qty FROM gr GROUP BY ALL", "facts routing members")(
    lambda s, d: rates.quantities(enrich.expand_groups(routed(s, d), members(s, d)), [*DEFECT, "grp", "day"])
)
query("ag18_mean_of_means", f"SELECT process, round(coalesce(avg(m) FILTER (m > 0), 0.0), 4) AS mean_ppm FROM (SELECT process, line, coalesce(avg(p) FILTER (p > 0), 0.0) AS m FROM (SELECT process, line, material, {PPM} AS p FROM facts GROUP BY ALL) GROUP BY ALL) GROUP BY 1", "facts")(
    lambda s, d: rounded(reports.mean_of_means(facts(s, d), ["process"], "material", "line").withColumn("mean_ppm", F.round("mean_ppm", 4)))
)
query("ag29_source_rows", "SELECT rid, line, process, ng, input, ng_qty FROM facts WHERE process = '1-URGENT' AND ng = 'PROMO' AND line = 'L1' AND day = DATE '1996-03-04'", "facts")(
    lambda s, d: readers.where_all(facts(s, d), {"process": "1-URGENT", "ng": "PROMO", "line": "L1"}).where("day = date'1996-03-04'").select("rid", "line", "process", "ng", "input", "ng_qty")
)
query("snk04_export_rows", f"""WITH {ROUTES}, c AS (SELECT process_type, process, ng, material, code, {PPM} AS ppm FROM (SELECT f.*, coalesce(e.pt, l.pt, '') AS process_type FROM facts f {ROUTE}) GROUP BY ALL)
  SELECT process_type, process, ng, material, code, nullif(ppm, 0) AS ppm, no FROM c JOIN (SELECT *, row_number() OVER (ORDER BY {RANK}, process, ng, process_type)::INTEGER AS no FROM (SELECT DISTINCT process_type, process, ng FROM c)) USING (process_type, process, ng)""", "facts routing")(
    lambda s, d: reports.export_rows(rates.combo_ppm(routed(s, d), [*DEFECT, "material", "code"]), DEFECT)
)

ITEMS = """items AS (SELECT r_name AS grp, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS material, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'big' ELSE 'big' || chr(31) || 'k' || (s_suppkey % 2) END AS path,
  n_name || '_' || s_suppkey AS line_shift, lpad(s_suppkey::VARCHAR, 10, '0') AS rid FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def items(s, d):
    """Group members with their paths: grp, material, path, line_shift, rid."""
    rows = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    path = F.when(key % 4 == 0, "").when(key % 4 == 1, "big").otherwise(F.concat(F.lit("big\x1fk"), (key % 2).cast("string")))
    return rows.select(F.col("r_name").alias("grp"), F.when(key % 3 == 0, "").otherwise(F.col("n_name")).alias("material"), path.alias("path"), F.concat("n_name", F.lit("_"), key.cast("string")).alias("line_shift"), F.lpad(key.cast("string"), 10, "0").alias("rid"))


OWN = "coalesce(nullif(material, ''), nullif(regexp_extract(line_shift, '^(.+)_[^_]*$', 1), ''), line_shift)"
query("rs07_tree", f"""WITH {ITEMS}, l AS (SELECT grp, {OWN} AS m, split(path, chr(31)) AS p, list(line_shift ORDER BY rid) AS ls, min(rid) AS rid FROM items GROUP BY ALL),
  t AS (SELECT grp, m, list({{'path': p, 'line_shifts': ls}} ORDER BY rid) AS sub, min(rid) AS rid FROM l GROUP BY ALL)
  SELECT grp, to_json(list({{'material': m, 'sub_groups': sub}} ORDER BY rid))::VARCHAR AS materials FROM t GROUP BY 1""")(
    lambda s, d: reports.nested_groups(items(s, d)).select("grp", F.to_json("materials").alias("materials"))
)
query("rs06_membership", f"""WITH {ITEMS}, o AS (SELECT grp, {OWN} AS m, list_filter(split(path, chr(31)), lambda x: x <> '') AS p, line_shift FROM items)
  SELECT DISTINCT name, line_shift FROM o, LATERAL (SELECT unnest(list_concat([grp, grp || ' / ' || m, line_shift], list_transform(range(1, len(p) + 1), lambda n: grp || ' / ' || m || ' / ' || array_to_string(p[:n], ' / ')))) AS name)""")(
    lambda s, d: reports.memberships(items(s, d).withColumn("material", text.material_of(F.col("material"), F.col("line_shift"))))
)
query("wn13_folder_order", """WITH x AS (SELECT source AS parent, lang AS name, true AS is_folder, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL UNION ALL SELECT source, doc_id::VARCHAR, false, strlen(text) FROM documents)
  SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_folder DESC, bytes DESC, name)::INTEGER AS place FROM x""")(
    lambda s, d: datasets.folder_order(
        table(s, d, "documents").groupBy(F.col("source").alias("parent"), F.col("lang").alias("name"), F.lit(True).alias("is_folder")).agg(F.sum(F.octet_length("text")).alias("bytes"))
        .unionByName(table(s, d, "documents").select(F.col("source").alias("parent"), F.col("doc_id").cast("string").alias("name"), F.lit(False).alias("is_folder"), F.octet_length("text").cast("long").alias("bytes")))
    )
)

# --- measurements and names ----------------------------------------------------------------------------------------

LOT = ", ".join(datasets.LOT)
query("vl01_issues", f"""WITH g AS (SELECT {LOT}, bool_or(defect_type = '__ALIGN_ERROR__') AS al, bool_or(trim(defect_type) <> '') AS named, bool_or(regexp_matches(lower(defect_type), 'moving|deform| ok|oqc')) AS crit,
  sum(CASE WHEN trim(defect_type) <> '' THEN defect_count ELSE 0 END)::BIGINT AS counted, string_agg(DISTINCT variable_detail, ' / ' ORDER BY variable_detail) AS details FROM measurements GROUP BY {LOT})
  SELECT {LOT}, counted, details, CASE WHEN al THEN 'align' WHEN NOT named OR crit OR (input = 0 AND ok = 0) OR (ng_total > 0 AND counted > ng_total) THEN NULL WHEN ng_total > 0 AND counted = 0 THEN 'missing'
  WHEN ng_total > 0 AND counted < ng_total THEN 'undercount' WHEN ng_total = 0 AND counted > 0 THEN 'contradict' END AS issue FROM g WHERE issue IS NOT NULL""", "measurements")(lambda s, d: datasets.issues(measurements(s, d)))
query("vl02_source_mismatch", "SELECT DISTINCT variable, variable_detail, input FROM measurements WHERE input >= 10 AND defect_type <> '__ALIGN_ERROR__' AND NOT regexp_matches(replace('lots of 1,000 and 101 or 2103', ',', ''), '(^|[^0-9])' || input || '($|[^0-9])')", "measurements")(
    lambda s, d: datasets.source_mismatch(measurements(s, d), F.lit("lots of 1,000 and 101 or 2103"))
)
query("fn11_criterion_label", "SELECT DISTINCT defect_type, regexp_matches(lower(defect_type), 'moving|deform| ok|oqc') AS criterion FROM measurements", "measurements")(
    lambda s, d: measurements(s, d).select("defect_type").distinct().withColumn("criterion", text.criterion_label(F.col("defect_type")))
)
query("ag22_weighted_pct", "SELECT dataset, variable_group, round(sum(ng_total) * 100.0 / sum(input), 6) AS pct FROM measurements WHERE trim(defect_type) = '' GROUP BY ALL HAVING sum(input) > 0", "measurements")(
    lambda s, d: rounded(rates.weighted_pct(measurements(s, d), ["dataset", "variable_group"]), "pct")
)
query("ag23_best_worst", """WITH v AS (SELECT dataset, variable, variable_detail, avg(ng_rate) AS p FROM measurements WHERE variable_group = 'test' AND trim(defect_type) = '' GROUP BY ALL)
  SELECT dataset, arg_min(variable, (p, variable, variable_detail)) AS best, arg_max(variable, (p, variable, variable_detail)) AS worst FROM v GROUP BY 1 HAVING count(*) >= 2""", "measurements")(lambda s, d: rates.best_and_worst(measurements(s, d), "dataset"))
query("ag24_top_defects", """WITH c AS (SELECT dataset, defect_type, sum(defect_count)::BIGINT AS n FROM measurements WHERE trim(defect_type) <> '' AND defect_count > 0 GROUP BY 1, 2), k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, defect_type) <= 5)
  SELECT m.dataset, 'maxNgRate=' || printf('%.1f', m.r) || '%, topDefects=[' || coalesce(t.l, 'none') || ']' AS summary FROM (SELECT dataset, max(ng_rate * 100) AS r FROM measurements GROUP BY 1) m
  LEFT JOIN (SELECT dataset, string_agg(defect_type || '(' || n || ')', ', ' ORDER BY n DESC, defect_type) AS l FROM k GROUP BY 1) t USING (dataset)""", "measurements")(lambda s, d: rates.defect_summary(measurements(s, d).withColumn("ng_rate", F.col("ng_rate") * 100), "dataset"))

NAMED = f"""n AS (SELECT p_partkey, p_size, p_type, {NAME} AS name, lpad(p_partkey::VARCHAR, 10, '0') AS rid FROM part), t AS (SELECT * FROM n)"""
EXACT = "lower(trim({}))"


def classified(name):
    return f"trim(regexp_replace(upper({NORMAL.format(f'trim({name})')}), '[^A-Z0-9-]+', ' ', 'g'))"


def name_rows(s, d):
    return table(s, d, "part").select("p_size", "p_type", noisy_name().alias("name"), F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("rid"))


def asked(s, d):
    """Names to label: all parts', some in other letters, some with a word more, and some unheard-of."""
    size, name = F.col("p_size") % 5, F.col("name")
    return name_rows(s, d).select(F.when(size == 0, F.upper(name)).when(size == 1, F.concat(F.lit("'"), name, F.lit('" '))).when(size == 2, F.concat(name, F.lit(" more"))).when(size == 3, F.lit("zzz 77")).otherwise(name).alias("name"))


ASKED = """a AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN upper(name) WHEN 1 THEN chr(39) || name || chr(34) || ' ' WHEN 2 THEN name || ' more' WHEN 3 THEN 'zzz 77' ELSE name END AS name FROM n)"""


def predicted(pick, least, default, rules=None):
    """SQL of the classifier: look-ups, rules and votes."""
    rules = rules or {"label": "", "confidence": "", "source": ""}
    return f"""WITH {NAMED}, {ASKED}, pr AS (SELECT p_type AS label, count(*) AS prior FROM t GROUP BY 1), v AS (SELECT token, p_type AS label, count(*) AS n FROM (SELECT p_type, unnest({TOKENS.format(NORMAL.format('name'))}) AS token FROM t) GROUP BY ALL),
  ex AS (SELECT {EXACT.format('name')} AS k, {pick}(p_type, rid) AS e FROM t GROUP BY 1), no AS (SELECT {classified('name')} AS k, {pick}(p_type, rid) AS e FROM t GROUP BY 1),
  s AS (SELECT a.name, pr.label, pr.prior + 2 * coalesce(sum(v.n), 0) AS score FROM a CROSS JOIN pr LEFT JOIN (SELECT name, unnest({TOKENS.format(NORMAL.format('name'))}) AS token FROM a) k ON k.name = a.name LEFT JOIN v ON v.token = k.token AND v.label = pr.label GROUP BY a.name, pr.label, pr.prior),
  w AS (SELECT name, arg_min(label, (-score, label)) AS label, round(least(greatest(max(score) / sum(score), {least}), 0.99), 6) AS confidence FROM s GROUP BY 1)
  SELECT a.name, CASE WHEN ex.e IS NOT NULL THEN ex.e WHEN no.e IS NOT NULL THEN no.e {rules['label']} ELSE coalesce(w.label, '{default}') END AS p_type,
  CASE WHEN ex.e IS NOT NULL THEN 1.0 WHEN no.e IS NOT NULL THEN 0.95 {rules['confidence']} ELSE w.confidence END::DOUBLE AS confidence,
  CASE WHEN ex.e IS NOT NULL THEN 'EXACT' WHEN no.e IS NOT NULL THEN 'NORMALIZED' {rules['source']} ELSE 'ML' END AS source
  FROM a LEFT JOIN ex ON ex.k = {EXACT.format('a.name')} LEFT JOIN no ON no.k = {classified('a.name')} LEFT JOIN w ON w.name = a.name"""


def ruled():
    tokens = TOKENS.format(NORMAL.format("a.name"))
    words = (("VISUAL", "VISUAL", 0.99), ("TEST", "FUNCTION", 0.97), ("SUB", "SUB", 0.96))
    pick = lambda what: " ".join(f"WHEN list_contains({tokens}, '{w}') THEN " + {"label": f"'{label}'", "confidence": str(c), "source": "'RULE'"}[what] for w, label, c in words)
    return {what: pick(what) for what in ("label", "confidence", "source")}


query("ml01_ml02_reason", predicted("arg_min", 0.55, ""))(
    lambda s, d: rounded(classifier.predict(asked(s, d), classifier.train(name_rows(s, d), ("name",), "p_type")), "confidence")
)
query("ml03_ml04_process_type", predicted("arg_max", 0.5, "MAIN", ruled()))(
    lambda s, d: rounded(classifier.predict(asked(s, d), classifier.train(name_rows(s, d), ("name",), "p_type", "last"), classifier.by_keywords("name"), 0.5, ("MAIN", 0.5)), "confidence")
)
query("ml04_last_wins", f"WITH {NAMED} SELECT name, arg_max(p_type, rid) AS p_type FROM n GROUP BY 1")(
    lambda s, d: classifier.looked_up(name_rows(s, d), classifier.train(name_rows(s, d), ("name",), "p_type", "last"))
)
query("ml05_retrained", f"WITH {NAMED} SELECT name, arg_max(label, (part, rid)) AS p_type FROM (SELECT name, p_type AS label, 0 AS part, rid FROM n UNION ALL SELECT name, 'FIXED', 1, rid FROM n WHERE p_size % 7 = 0) GROUP BY 1")(
    lambda s, d: classifier.looked_up(
        name_rows(s, d), classifier.retrain(name_rows(s, d), name_rows(s, d).where("p_size % 7 = 0").withColumn("p_type", F.lit("FIXED")), ("name",), "p_type", "last")
    )
)
query("jn09_insert_missing", f"""WITH o AS (SELECT DISTINCT p_brand AS brand, p_type AS name FROM part WHERE p_size % 2 = 0),
  n AS (SELECT p_brand AS brand, {NORMAL.format("chr(39) || p_type || '  '")} AS name FROM part)
  SELECT * FROM o UNION ALL SELECT DISTINCT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.brand = n.brand AND {NORMAL.format('o.name')} = n.name)""")(
    lambda s, d: enrich.insert_missing(
        table(s, d, "part").where("p_size % 2 = 0").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("name")).distinct(),
        table(s, d, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("'"), "p_type", F.lit("  ")).alias("name"), "p_partkey"), ["brand", "name"], ("name",), "p_partkey",
    )
)
JSON = """'{"RecordNo":"' || c_custkey || '","Model":"' || c_mktsegment || '","Shift":"N","Input":"1,200","Ok":"' || CASE WHEN c_custkey % 3 = 0 THEN 'bad' ELSE '7' END || '"}'"""
query("rs10_typed_records", "SELECT c_custkey AS id, '' AS TestDate, 'N' AS Shift, c_mktsegment AS Model, c_custkey AS RecordNo, 1200::BIGINT AS Input, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 7 END::BIGINT AS Ok, 0::BIGINT AS TotalNG FROM customer WHERE lower(c_mktsegment) = 'building'")(
    lambda s, d: datasets.typed_records(
        table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit('{"RecordNo":"'), F.col("c_custkey").cast("string"), F.lit('","Model":"'), "c_mktsegment", F.lit('","Shift":"N","Input":"1,200","Ok":"'), F.when(F.col("c_custkey") % 3 == 0, "bad").otherwise("7"), F.lit('"}')).alias("row")),
        "row", ["TestDate", "Shift", "Model"], ["RecordNo", "Input", "Ok", "TotalNG"], {"Model": "Building", "Shift": "All"},
    )
)
query("rs11_term_lines", """WITH l AS (SELECT c_mktsegment AS term, 'says: ' || c_name AS description, lpad(c_custkey::VARCHAR, 10, '0') AS rid FROM customer) SELECT term, description FROM l QUALIFY row_number() OVER (PARTITION BY term ORDER BY rid DESC) = 1
  UNION ALL SELECT 'OLD', 'kept'""")(
    lambda s, d: datasets.upsert(
        s.range(1).select(F.explode(F.array(F.struct(F.lit("OLD").alias("term"), F.lit("kept").alias("description")), F.struct(F.lit("BUILDING").alias("term"), F.lit("replaced").alias("description")))).alias("r")).select("r.*"),
        datasets.term_lines(table(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("rid"), F.concat(F.lit("\n no term here\n"), "c_mktsegment", F.lit(" : says: "), "c_name", F.lit("\n: empty")).alias("lines")), "lines"), ["term"],
    )
)

# --- statistics ----------------------------------------------------------------------------------------------------

query("st06_shared_limits", f"""{LIMITS}, x AS (SELECT name, y, CASE WHEN name = 'view' THEN g + 0.0 ELSE low END AS low, CASE WHEN name = 'click' AND g = 1 THEN NULL ELSE high END AS high FROM v)
  SELECT name, min(y) AS lowest, max(y) AS highest, round(avg(y), 6) AS mean, count(*) AS n, count(*) FILTER (y > high OR (y < low AND high IS NOT NULL)) AS ng, round(count(*) FILTER (y > high OR (y < low AND high IS NOT NULL)) / count(*) * 1e6, 4) AS ppm,
  round(CASE WHEN count(high) = count(*) AND max(low) - min(low) < 1e-12 AND max(high) - min(high) < 1e-12 AND stddev_pop(y) > 0 THEN least((max(high) - avg(y)) / (3 * stddev_pop(y)), (avg(y) - min(low)) / (3 * stddev_pop(y))) END, 6) AS cpk FROM x GROUP BY 1""")(
    lambda s, d: rounded(quality.shared_limit_summary(values(s, d).withColumns({"low": F.when(F.col("name") == "view", F.col("g").cast("double")).otherwise(F.col("low")), "high": F.when((F.col("name") == "click") & (F.col("g") == 1), None).otherwise(F.col("high"))}), ["name"]), "mean", "cpk").withColumn("ppm", F.round("ppm", 4))
)
X = "(event_id % 97) / 10.0"


def curved(s, d):
    """Values with a bent line in x, by event type: name, x, y."""
    x = (F.col("event_id") % 97) / 10.0
    return table(s, d, "events").select(F.col("event_type").alias("name"), x.alias("x"), (F.col("value") / 50 + 3 * x - 0.2 * x * x).alias("y"))


CURVED = f"WITH w AS (SELECT event_type AS name, {X} AS x, value / 50 + 3 * {X} - 0.2 * {X} * {X} AS y FROM events)"
query("st12_quadratic", f"""{CURVED}, m AS (SELECT name, avg(x) AS m, avg(y) AS my FROM w GROUP BY 1), p AS (SELECT name, m, my, count(*)::DOUBLE AS n, sum((x-m)) AS s1, sum((x-m)**2) AS s2, sum((x-m)**3) AS s3, sum((x-m)**4) AS s4, sum(y-my) AS t0, sum((y-my)*(x-m)) AS t1, sum((y-my)*(x-m)**2) AS t2, sum((y-my)**2) AS vv FROM w JOIN m USING (name) GROUP BY ALL),
  k AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM p), c AS (SELECT *, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det AS p, (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det AS q, (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det AS r FROM k)
  SELECT name, round(my + p - q*m + r*m*m, 4) AS a, round(q - 2*r*m, 4) AS b, round(r, 4) AS c, round(1 - (vv - p*t0 - q*t1 - r*t2) / vv, 4) AS r2 FROM c""")(
    lambda s, d: quality.quadratic(curved(s, d), ["name"]).select("name", *[F.round(c, 4).alias(c) for c in ("a", "b", "c", "r2")])
)
Z99 = 2.3263478743880279  # fixed value: the z of 0.99 by the approximation that ``inverse_normal`` uses
query("st15_required_x", f"""{CURVED}, a AS (SELECT name, x, y FROM w UNION ALL SELECT 'flat', x, y - 3 * x + 0.2 * x * x FROM w UNION ALL SELECT 'point', 1.0, y FROM w),
  f AS (SELECT name, count(*) AS n, regr_slope(y, x) AS m, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2, sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / nullif(regr_sxx(y, x), 0)) / (count(*) - 2)) AS sd, max(x) - min(x) AS rng, regr_sxx(y, x) AS sxx FROM a GROUP BY 1)
  SELECT name, CASE WHEN n < 3 OR abs(n * sxx) < 1e-12 THEN 'Unavailable' WHEN abs(m) < 0.001 OR r2 < 0.05 OR abs(m) * rng < sd / 2 THEN 'Unstable' ELSE 'Calculated' END AS state,
  CASE WHEN n < 3 OR abs(n * sxx) < 1e-12 OR abs(m) < 0.001 OR r2 < 0.05 OR abs(m) * rng < sd / 2 THEN NULL ELSE round((5.0 + {Z99} * sd - b) / m, 3) END AS required_x FROM f""")(
    lambda s, d: quality.required_x(
        curved(s, d).unionByName(curved(s, d).select(F.lit("flat").alias("name"), "x", (F.col("y") - 3 * F.col("x") + 0.2 * F.col("x") * F.col("x")).alias("y"))).unionByName(curved(s, d).select(F.lit("point").alias("name"), F.lit(1.0).alias("x"), "y")), ["name"], 0.01, 5.0
    ).withColumn("required_x", F.round("required_x", 3))
)


def polynomial(x, factors):
    found = repr(factors[0])
    for f in factors[1:]:
        found = f"({found}) * ({x}) + {f!r}"
    return found


def inverse_normal_sql(p):
    tail = lambda q: f"({polynomial(q, measures.TAIL_TOP)}) / ({polynomial(q, measures.TAIL_BOTTOM)})"
    q = f"({p} - 0.5)"
    centre = f"{q} * ({polynomial(f'{q} * {q}', measures.CENTRE_TOP)}) / ({polynomial(f'{q} * {q}', measures.CENTRE_BOTTOM)})"
    return f"CASE WHEN {p} < {measures.TAIL} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 1 - {measures.TAIL} THEN -({tail(f'sqrt(-2 * ln(1 - {p}))')}) ELSE {centre} END"


query("st16_inverse_normal", f"SELECT o_orderkey, round({inverse_normal_sql('p')}, 6) + 0.0 AS z FROM (SELECT o_orderkey, (o_orderkey % 999 + 1) / 1000.0::DOUBLE AS p FROM orders)")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", (F.round(measures.inverse_normal((F.col("o_orderkey") % 999 + 1) / 1000), 6) + 0.0).alias("z"))
)
query("st17_limits", f"""{LIMITS}, c AS (SELECT name, g, avg(y) AS m, greatest(stddev_pop(y), 1e-7) AS sd FROM v GROUP BY ALL), l AS (SELECT name, regr_slope(m, g) AS a, regr_intercept(m, g) AS b, regr_slope(sd, g) AS c, regr_intercept(sd, g) AS e FROM c GROUP BY 1), z AS (SELECT {inverse_normal_sql('0.995::DOUBLE')} AS z)
  SELECT name, round(min(m - z * sd), 3) AS low, round(max(m + z * sd), 3) AS high, round(min(a * g + b - z * greatest(c * g + e, 1e-7)), 3) AS trend_low, round(max(a * g + b + z * greatest(c * g + e, 1e-7)), 3) AS trend_high FROM c JOIN l USING (name), z GROUP BY 1""")(
    lambda s, d: quality.recommended_limits(quality.column_stats(values(s, d), ["name", "g"]), ["name"], "g", 0.01).select("name", *[F.round(c, 3).alias(c) for c in ("low", "high", "trend_low", "trend_high")])
)
query("st18_density", f"""{LIMITS}, t AS (SELECT name, avg(y) AS m, stddev_pop(y) AS sd, min(y) AS lo, max(y) AS hi FROM v GROUP BY 1), x AS (SELECT name, i::INTEGER AS i, m, sd, lo - sd + (hi - lo + 2 * sd) * i / 100 AS x FROM t, range(0, 101) r(i) WHERE sd > 0)
  SELECT name, i, round(x, 3) AS x, round(exp(-0.5 * ((x - m) / sd) ** 2) / (sd * sqrt(2 * pi())), 6) AS density FROM x""")(
    lambda s, d: quality.density(quality.column_stats(values(s, d), ["name"])).select("name", "i", F.round("x", 3).alias("x"), F.round("density", 6).alias("density"))
)
query("st14_column_deltas", """WITH m AS (SELECT avg(l_quantity) AS a, avg(l_tax) AS b, avg(l_discount) AS c, avg(l_extendedprice) AS e FROM lineitem)
  SELECT 1 AS step, 'l_quantity' AS from_column, 'l_tax' AS to_column, round(b - a, 4) AS delta FROM m UNION ALL SELECT 2, 'l_tax', 'l_discount', round(c - b, 4) FROM m UNION ALL SELECT 3, 'l_discount', 'l_extendedprice', round(e - c, 4) FROM m""")(
    lambda s, d: quality.column_deltas(table(s, d, "lineitem"), ["l_quantity", "l_tax", "l_discount", "l_extendedprice"]).withColumn("delta", F.round("delta", 4))
)
query("st19_heat_map", "SELECT p_type || '|' || p_brand AS x, p_size AS y, round(avg(p_retailprice), 6) AS value FROM part GROUP BY ALL")(
    lambda s, d: rounded(quality.heat_map(table(s, d, "part"), F.concat_ws("|", "p_type", "p_brand"), F.col("p_size"), F.col("p_retailprice")), "value")
)
query("st19_ppm_heat_map", "SELECT line AS x, code AS y, round(avg(CASE WHEN input > 0 THEN ng_qty * 1e6 / input END), 4) AS value FROM facts GROUP BY ALL", "facts")(
    lambda s, d: quality.ppm_heat_map(facts(s, d), F.col("line"), F.col("code"), "ng_qty", "input").withColumn("value", F.round("value", 4))
)
query("st20_numeric_labels", "SELECT label, row_number() OVER (ORDER BY label::DOUBLE, label)::INTEGER AS place FROM (SELECT DISTINCT p_size::VARCHAR AS label FROM part)")(lambda s, d: quality.label_order(table(s, d, "part").select(F.col("p_size").cast("string").alias("label")), "label"))
query("st20_text_labels", "SELECT label, row_number() OVER (ORDER BY lower(label), label)::INTEGER AS place FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN lower(p_type) || p_size ELSE p_type || p_size END AS label FROM part)")(
    lambda s, d: quality.label_order(table(s, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lower("p_type"), F.col("p_size").cast("string"))).otherwise(F.concat("p_type", F.col("p_size").cast("string"))).alias("label")), "label")
)
query("st21_category_buckets", """WITH x AS (SELECT p_partkey, p_retailprice AS y, CASE WHEN p_size % 5 = 0 THEN '(blank)' ELSE p_type END || ' | ' || CASE WHEN p_size % 7 = 0 THEN '(blank)' ELSE p_size::VARCHAR END AS label FROM part)
  SELECT label, row_number() OVER (ORDER BY min(p_partkey))::INTEGER AS place, round(avg(y), 6) AS value FROM x GROUP BY 1""")(
    lambda s, d: rounded(quality.category_buckets(table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("y"), F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_type")).alias("a"), F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size")).alias("b")), ["a", "b"], "y", "p_partkey"), "value")
)
query("st22_category_index", "WITH x AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_type END AS label FROM part) SELECT arg_min(label, p_partkey) AS label, (row_number() OVER (ORDER BY min(p_partkey)) - 1)::INTEGER AS place FROM x GROUP BY lower(label)")(
    lambda s, d: classifier.category_index(table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("label")), "label", "p_partkey")
)
query("st26_type_sniff", "SELECT 'value' AS name, 'Numeric' AS kind UNION ALL SELECT 'day', 'Date' UNION ALL SELECT 'event_type', 'Category'")(
    lambda s, d: quality.type_sniff(table(s, d, "events").select(F.col("value").cast("string").alias("value"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.date_format("ts", "d-MMM-yyyy")).alias("day"), "event_type"), ["value", "day", "event_type"], 2024)
)
query("jn16_aligned_curves", """WITH p AS (SELECT event_type AS curve, round((event_id % CASE WHEN event_type IN ('click', 'view') THEN 50 ELSE 30 END) / 7.0, 2) AS x, max(value) AS y FROM events GROUP BY ALL),
  k AS (SELECT curve, list(x ORDER BY x) AS xs FROM p GROUP BY 1) SELECT f.family, p.curve, x, y FROM p JOIN k USING (curve) JOIN (SELECT xs, min(curve) AS family FROM k GROUP BY 1) f USING (xs)""")(
    lambda s, d: quality.aligned_curves(
        table(s, d, "events").groupBy(F.col("event_type").alias("curve"), F.round((F.col("event_id") % F.when(F.col("event_type").isin("click", "view"), 50).otherwise(30)) / 7.0, 2).alias("x")).agg(F.max("value").alias("y")).withColumn("x", F.col("x") + 0.001)
    )
)

# --- text and dates ------------------------------------------------------------------------------------------------

query("fn03_compared", f"SELECT p_partkey, trim('  ' || p_name || '+  ') AS plain, {NORMAL.format(chr(39) + '  ' + chr(39) + ' || p_name || ' + chr(39) + '+  ' + chr(39))} AS normal FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("+  ")).alias("n")).select("p_partkey", text.compared(F.col("n")).alias("plain"), text.compared(F.col("n"), True).alias("normal"))
)
query("fn06_sheet_name", r"SELECT p_partkey, left(regexp_replace(p_name || '/[x]:*?\' || p_name, '[\\/?*\[\]:]', '_', 'g'), 31) AS name FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", text.sheet_name(F.concat("p_name", F.lit("/[x]:*?\\"), "p_name")).alias("name"))
)
FORMATS = (("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"), ("MM-dd", None), ("M/d", None), ("d-MMM", None), ("dd-MMM-yyyy", "%d-%b-%Y"), ("d-MMM-yy", "%-d-%b-%y"), ("dd/MMM", None), ("yyyy.MM.dd", ""))


def written_dates(s, d):
    day, n = F.to_date("o_orderdate"), F.col("o_orderkey") % len(FORMATS)
    found = F.lit(None).cast("string")
    for i, (f, _) in enumerate(FORMATS):
        found = F.when(n == i, F.date_format(day, f)).otherwise(found)
    return table(s, d, "orders").select("o_orderkey", F.concat(F.lit(" "), found).alias("t"))


PARSED = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN " + ("NULL" if sql == "" else "day" if sql else "make_date(2024, month(day), day(day))") for i, (_, sql) in enumerate(FORMATS)) + " END"
query("fn07_prj07_parse_date", f"SELECT o_orderkey, {PARSED} AS day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)")(
    lambda s, d: written_dates(s, d).select("o_orderkey", text.parse_date(F.col("t"), 2024).alias("day"))
)
query("prj07_rows_with_dates", "SELECT kind, count(*) AS n FROM (SELECT o_orderkey, unnest(['D', 'W', 'M']) AS kind FROM orders WHERE o_orderkey % 9 <> 8) GROUP BY 1")(
    lambda s, d: periods.by_grain(written_dates(s, d).select(text.parse_date(F.col("t"), 2024).alias("day"))).groupBy("kind").agg(F.count("*").alias("n"))
)
query("fn08_dd07_numbers", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN 1234567.5 END AS n, CASE p_size % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN 1234567.5 ELSE 0 END AS z FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).when(F.col("p_size") % 3 == 1, "1,234,567.5").otherwise("n/a").alias("t")).select("p_partkey", text.number(F.col("t")).alias("n"), text.number_or_zero(F.col("t")).alias("z"))
)
query("fn09_same_date", "SELECT o_orderkey, o_orderkey % 4 <> 3 AS same FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 4).alias("k"))
    .select("o_orderkey", text.same_date(F.when(F.col("k") == 1, " Same TEXT").otherwise(F.date_format("day", "yyyy-MM-dd")), F.when(F.col("k") == 1, "same text ").when(F.col("k") == 3, "1901-01-01").when(F.col("k") == 2, F.date_format("day", "d-MMM-yyyy")).otherwise(F.date_format("day", "yyyy/MM/dd")), 2023).alias("same"))
)
query("fn12_percent", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS pct FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", text.percent(F.when(F.col("p_size") % 4 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5 %")))).alias("pct"))
)
query("fn14_month_name", "SELECT DISTINCT 'M' || month(o_orderdate) AS key, strftime(o_orderdate, '%b') AS name FROM orders UNION SELECT 'M13', 'M13'")(
    lambda s, d: table(s, d, "orders").select(F.concat(F.lit("M"), F.month("o_orderdate").cast("string")).alias("key")).union(s.range(1).select(F.lit("M13"))).distinct().withColumn("name", text.month_name(F.col("key")))
)
query("fn15_shifted_keys", """SELECT DISTINCT kind, key, CASE kind WHEN 'D' THEN strftime(strptime(key, '%Y%m%d') - INTERVAL 2 DAY, '%Y%m%d') WHEN 'W' THEN CASE WHEN right(key, 2)::INTEGER > 1 THEN (key::INTEGER - 1)::VARCHAR
  ELSE (left(key, 4)::INTEGER - 1) || weekofyear(make_date(left(key, 4)::INTEGER - 1, 12, 28))::VARCHAR END ELSE key END AS before FROM by_grain""", "facts by_grain")(
    lambda s, d: periods.by_grain(facts(s, d).select("day").distinct()).select("kind", "key").distinct().withColumn("before", periods.shifted(F.col("kind"), F.col("key")))
)
query("fn16_fenced_json", """SELECT p_partkey, '{"k":"' || p_name || '"}' AS json FROM part""")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit('Here it is:\n```json\n{"k":"'), "p_name", F.lit('"}\n```\nDone.')).alias("a"), F.concat(F.lit('So {"k":"'), "p_name", F.lit('"} it is')).alias("b")).select("p_partkey", text.fenced_json(F.when(F.col("p_partkey") % 2 == 0, F.col("a")).otherwise(F.col("b"))).alias("json"))
)
query("fn17_categories", "SELECT p_partkey, p_type, coalesce(CASE WHEN lower(p_type) = 'promo' THEN 'Last' WHEN lower(p_type) = 'economy' THEN 'Cheap' END, p_type) AS category FROM part")(
    lambda s, d: enrich.category(table(s, d, "part").select("p_partkey", "p_type"), s.createDataFrame([("PROMO", "First", 1), ("promo", "Last", 2), ("Economy", "Cheap", 3), ("", "None", 4)], "code string, name string, rid int"), "p_type")
)
query("prj15_keep_and_drop", "SELECT p_partkey, p_name FROM part")(lambda s, d: readers.only(readers.without(table(s, d, "part"), ["p_brand", "nothing"]), ["p_partkey", "missing", "p_name", "p_brand"]))
query("prj16_set05_common_columns", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")(
    lambda s, d: readers.common_columns(table(s, d, "nation"), s.createDataFrame([], "n_nationkey int, extra string, n_name string"), ("n_regionkey", [1, 3]))
)
@query("flt10_exists", "SELECT r_regionkey, (SELECT count(*) FROM nation) AS t, (SELECT count(n_name) FROM nation) AS c, NULL::BIGINT AS no_column, NULL::BIGINT AS no_table FROM region")
def _(s, d):
    """Counts of rows of the tables and columns that there are, behind each region; null for the others."""
    table(s, d, "nation").createOrReplaceTempView("nation_of_flt10")
    asked = {"t": ("nation_of_flt10",), "c": ("nation_of_flt10", "N_Name"), "no_column": ("nation_of_flt10", "x"), "no_table": ("nothing_of_flt10",)}
    counts = [(F.count(a[1] if len(a) > 1 else "*") if readers.exists(s, *a) else F.lit(None).cast("long")).alias(n) for n, a in asked.items()]
    return table(s, d, "region").select("r_regionkey").crossJoin(F.broadcast(s.table("nation_of_flt10").agg(*counts)))  # one row


query("set01_fresh_and_cached", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '1998-07-01' THEN 'fetch' ELSE 'cache' END AS source FROM orders")(
    lambda s, d: table(s, d, "orders").where("o_orderdate >= timestamp_ntz'1998-07-01'").select("o_orderkey", F.lit("fetch").alias("source")).unionByName(table(s, d, "orders").where("o_orderdate < timestamp_ntz'1998-07-01'").select("o_orderkey", F.lit("cache").alias("source")))
)
query("set03_with_separators", "SELECT n_name AS name FROM nation UNION ALL SELECT NULL UNION ALL SELECT r_name FROM region UNION ALL SELECT NULL")(
    lambda s, d: readers.with_separators([table(s, d, "nation").select(F.col("n_name").alias("name")), table(s, d, "region").select(F.col("r_name").alias("name"))])
)

# --- files ---------------------------------------------------------------------------------------------------------


def text_file(s, name, rows, header):
    """A text file of ``rows`` (column value) under ``header`` in a scratch folder; its path."""
    path = writers.scratch(s, name)
    writers.lines(rows, path, header)
    return path


def nation_lines(s, d, *parts):
    return table(s, d, "nation").select(F.concat(*parts).alias("value"))


def key_text():
    return F.col("n_nationkey").cast("string")


def short():
    """Some names alone, for lines that are too short."""
    return F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name"))


@query("src05_cached_days", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-05')")
def _(s, d):
    path = writers.scratch(s, "days")
    writers.replace_partitions(table(s, d, "events").select("event_id", F.to_date("ts").alias("day")), path, ["day"])
    return readers.cached_days(s, path, ["2024-01-03", "2024-01-05", "1990-01-01"], "event_id bigint")


query("src09_json_roots", "SELECT n_name AS name FROM nation")(
    lambda s, d: readers.json_records(
        table(s, d, "nation").select(F.to_json(F.array(F.struct("n_name"))).alias("a"), (F.col("n_nationkey") % 5).alias("k")).select(
            F.when(F.col("k") == 0, F.col("a")).when(F.col("k") == 1, F.concat(F.lit('{"data":{"contents":'), "a", F.lit("}}"))).when(F.col("k") == 2, F.concat(F.lit('{"data":'), "a", F.lit("}")))
            .when(F.col("k") == 3, F.concat(F.lit('{"rows":'), "a", F.lit("}"))).otherwise(F.concat(F.lit('{"contents":'), "a", F.lit("}"))).alias("body")
        ), "body", {"n_name": "name"},
    )
)
query("src10_master_tsv", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_nationkey::VARCHAR END AS k FROM nation")(
    lambda s, d: readers.master_tsv(s, text_file(s, "master", nation_lines(s, d, F.coalesce(short(), F.concat(F.lit(" "), "n_name", F.lit("\t"), key_text(), F.lit(" ")))), "Name\tKey"), ["name", "k"])
)
query("src11_strict_tsv", "SELECT n_name AS name, n_nationkey::VARCHAR AS k FROM nation WHERE n_nationkey % 5 <> 0")(
    lambda s, d: readers.strict_tsv(s, text_file(s, "strict", nation_lines(s, d, F.coalesce(short(), F.concat("n_name", F.lit("\t"), key_text(), F.lit("\tmore")))), "name\tk\tother"), ["name", "k"])
)
query("src12_headerless", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey::VARCHAR END AS k FROM nation UNION ALL SELECT 'name', 'k'")(
    lambda s, d: readers.headerless(s, text_file(s, "plain", nation_lines(s, d, F.coalesce(short(), F.concat("n_name", F.lit("\t"), key_text())), F.lit("\n ")), "name\tk"), ["name", "k"])
)
query("src13_delimited", "SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_nationkey::VARCHAR END AS k, '' AS k_2 FROM nation UNION ALL SELECT 'name', 'k', 'K'")(
    lambda s, d: readers.delimited(s, text_file(s, "table", nation_lines(s, d, F.coalesce(short(), F.concat("n_name", F.lit(" ; "), key_text()))).union(s.range(1).select(F.lit("name;k;K"))), "made by hand\n\nname;k;K"), ";", 3).withColumnRenamed("K_2", "k_2")
)
query("src14_dated_values", "SELECT CAST(o_orderdate AS DATE) AS Date, o_orderkey::DOUBLE AS Value1, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 2.5 END::DOUBLE AS Value2 FROM orders")(
    lambda s, d: readers.dated_values(s, text_file(s, "dated", table(s, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(","), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(",2.5")).alias("value")), ""), 2)
)
query("src17_split_at_spaces", "SELECT w[1] AS a, w[2] AS b FROM (SELECT regexp_split_to_array(r_name || ' ' || r_regionkey, ' +') AS w FROM region)")(
    lambda s, d: readers.delimited(s, text_file(s, "spaced", table(s, d, "region").select(F.concat(F.lit("  "), "r_name", F.lit(" \t "), F.col("r_regionkey").cast("string")).alias("value")), " a  b "), " ")
)
query("src18_scatter", "SELECT replace(n_name, ' ', '_') AS name, n_nationkey::VARCHAR AS k FROM nation")(
    lambda s, d: readers.scatter(s, text_file(s, "scatter", table(s, d, "nation").select(F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.when(F.col("n_nationkey") % 2 == 0, ",").otherwise("  "), key_text()).alias("value")), "name,k"))
)
query("src19_curve_cells", """SELECT 'f' || n_regionkey AS file, 'Curve' AS sheet, (n_nationkey + 0.5)::DOUBLE AS x, (n_nationkey * 2)::DOUBLE AS y FROM nation WHERE row_of < 3 AND row_of <> 1 UNION ALL SELECT 'f' || r_regionkey, 'impedance', 4.0::DOUBLE, 8.0::DOUBLE FROM region""".replace("FROM nation WHERE", "FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_of FROM nation) WHERE"))(
    lambda s, d: readers.curve_cells(cells(s, d)).select("file", "sheet", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
)


def cells(s, d):
    """Cells of sheets: curves with a text in their second row and a blank after the third, and impedances."""
    n, at = F.col("n_nationkey"), F.row_number().over(readers.Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    rows = table(s, d, "nation").select("n_regionkey", n.alias("k"), at.alias("at"))
    x = F.when(F.col("at") == 1, "text").when(F.col("at") == 3, None).otherwise((F.col("k") + 0.5).cast("string"))
    own = F.array(F.struct(F.lit(1).alias("col"), x.alias("value")), F.struct(F.lit(2).alias("col"), (F.col("k") * 2).cast("string").alias("value")))
    curves = rows.select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("file"), F.lit("Curve").alias("sheet"), (F.col("at") + 5).alias("row"), F.explode(own).alias("c")).select("file", "sheet", "row", "c.*")
    alone = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(str(r * c)).alias("value")) for r in (4, 5) for c in (1, 2)])
    single = table(s, d, "region").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("file"), F.lit("impedance").alias("sheet"), F.explode(alone).alias("c")).select("file", "sheet", "c.*")
    return curves.unionByName(single)


@query("src22_snk03_csv", """SELECT p_partkey::VARCHAR AS k, p_name || ', "' || p_type || '"' AS name, '' AS nothing FROM part""")
def _(s, d):
    path = writers.scratch(s, "csv")
    writers.csv(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("name"), F.lit("").alias("nothing")), path)
    return readers.training_csv(s, path, ["k", "name", "nothing"])


@query("snk01_snk02_append_and_overwrite", "SELECT 'appended' AS how, 2 * count(*) AS n FROM nation UNION ALL SELECT 'overwritten', count(*) FROM nation")
def _(s, d):
    rows, one, two = table(s, d, "nation"), writers.scratch(s, "append"), writers.scratch(s, "overwrite")
    for _ in range(2):
        writers.append(rows, one)
        writers.overwrite(rows, two)
    count = lambda path, how: s.read.schema(rows.schema).parquet(path).agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "n")
    return count(one, "appended").unionByName(count(two, "overwritten"))


@query("snk05_tsv", "SELECT doc_id::VARCHAR AS doc_id, coalesce(regexp_replace(text, '[\\t\\r\\n]+', ' ', 'g'), '') AS text FROM documents")
def _(s, d):
    path = writers.scratch(s, "tsv")
    writers.tsv(table(s, d, "documents").select("doc_id", "text"), path)
    lines = readers.numbered_lines(s, path)
    parts = F.split("value", "\t", 2)
    return lines.where("not (first and line = 1)").select(parts[0].alias("doc_id"), parts[1].alias("text"))
