"""Report shapes: periods as columns, and the worst defects, processes and reasons of a group.

Periods are (kind, key) with kinds D, W and M. Rankings break ties by explicit columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.measures import ppm
from gaugeworks.functions.text import material_of, process_rank
from gaugeworks.operators.ranking import top, top_by

DEFECT = ["process_type", "process", "ng"]


def newest_periods(rows: DataFrame, limits: dict[str, int]) -> list[tuple[str, str]]:
    """The newest (kind, key) of each kind, newest first: what a report has as columns, some dozens at most."""
    keys = rows.select("kind", "key").distinct()
    at = Window.partitionBy("kind").orderBy(F.desc("key"))
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    found = keys.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= F.element_at(most, F.col("kind"))).collect()
    order = list(limits)
    return [(r.kind, r.key) for r in sorted(found, key=lambda r: (order.index(r.kind), r._n))]


def period_pivot(rows: DataFrame, by: list[str], columns: list[tuple[str, str]], measures: dict[str, Column]) -> DataFrame:
    """A row for each ``by`` and for each period a column of each measure, in the order of ``columns``; 0 where there is none.

    Columns are named by kind and key, and by the measure too where there are several. Between kinds comes an empty
    separator column.
    """
    found, before = [], None
    for kind, key in columns:
        if before not in (None, kind):
            found.append(F.lit(None).cast("string").alias(f"sep_{kind}"))
        before = kind
        here = (F.col("kind") == kind) & (F.col("key") == key)
        for name, measure in measures.items():
            found.append(F.coalesce(F.max(F.when(here, measure)), F.lit(0)).alias(f"{kind}{key}" + (f"_{name}" if len(measures) > 1 else "")))
    return rows.where(F.struct("kind", "key").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in columns])).groupBy(*by).agg(*found)


def detail_pivot(rows: DataFrame, columns: list[tuple[str, str]], groups: list[str]) -> DataFrame:
    """PPM of each defect in (period, group) columns; on top a TOTAL row and one for each process type, of summed rates.

    All three levels are grouping sets of one aggregate over the rates.

    ``rows`` have process_type, process, ng, grp, kind, key, input, ng_qty; ``place`` orders the report.
    """
    each = rows.groupBy(*DEFECT, "grp", "kind", "key").agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("ppm"))
    cells = [
        F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("key") == key) & (F.col("grp") == g), F.col("ppm"))), F.lit(0.0)).alias(f"{kind}{key}_{g}")
        for kind, key in columns
        for g in groups
    ]
    names = [F.col(c) for c in DEFECT]
    sets = each.groupingSets([[], names[:1], names], *names).agg(*cells, F.grouping("process_type").alias("_all"), F.grouping("ng").alias("_any"))
    place = F.lit(3) - F.col("_all") - F.col("_any")
    kind = F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("process_type"))
    blank = lambda c: F.when(F.col("_any") == 1, "").otherwise(F.col(c)).alias(c)
    found = sets.select(place.cast("int").alias("place"), kind.alias("process_type"), blank("process"), blank("ng"), *[c for c in sets.columns if c not in (*DEFECT, "_all", "_any")])
    return found if columns and groups else found.distinct()


def aligned_headers(reports: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Long reports (``by``, kind, key, ppm) on the union of their period headers: report, ``by``, kind, key, ppm, with a
    0 where a report lacks a period of the others."""
    named = [df.select(F.lit(name).alias("report"), *by, "kind", "key", "ppm") for name, df in reports.items()]
    every = named[0]
    for df in named[1:]:
        every = every.unionByName(df)
    headers = every.select("kind", "key").distinct().agg(F.collect_set(F.struct("kind", "key")).alias("h"))  # a report's columns
    names = every.select("report", *by).distinct().crossJoin(F.broadcast(headers)).select("report", *by, F.explode("h").alias("h"))
    return names.select("report", *by, "h.kind", "h.key").join(every, ["report", *by, "kind", "key"], "left").fillna(0.0, ["ppm"])


def reference_key(rows: DataFrame, kind: str, offset: int) -> DataFrame:
    """One row: the key of ``kind`` that is ``offset`` periods before the newest, or the oldest if there are fewer."""
    keys = rows.where(F.col("kind") == kind).select("key").distinct().orderBy(F.desc("key")).limit(offset + 1)
    return keys.agg(F.min("key").alias("key"))


def _in_period(rows: DataFrame, kind: str, offset: int) -> DataFrame:
    return rows.where(F.col("kind") == kind).join(F.broadcast(reference_key(rows, kind, offset)), "key", "left_semi")  # one row


def worst_defects(rows: DataFrame, group: str, kind: str = "W", offset: int = 1, n: int = 10) -> DataFrame:
    """The ``n`` defects with the highest rate of one group in a reference period: rank, defect, rate of the reference."""
    here = _in_period(rows, kind, offset).where(F.col("grp") == group)
    each = here.groupBy(*DEFECT).agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("reference_ppm"))
    return top(each, n, "reference_ppm", DEFECT)


def worst_processes(rows: DataFrame, group: str, kind: str = "W", offset: int = 1, n: int = 10) -> DataFrame:
    """The ``n`` processes with the highest sum of their defects' rates of one group in a reference period."""
    here = _in_period(rows, kind, offset).where(F.col("grp") == group)
    each = here.groupBy(*DEFECT).agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("ppm"))
    return top(each.groupBy("process_type", "process").agg(F.sum("ppm").alias("reference_ppm")), n, "reference_ppm", ["process_type", "process"])


def over_groups(worst: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The ranked ``key`` with its rates in every group and period of ``rows``: rates of defects, summed over them."""
    each = rows.join(F.broadcast(worst.select("rank", *key)), key)  # n rows
    rates = each.groupBy("rank", *dict.fromkeys([*key, "ng"]), "grp", "kind", "key").agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("ppm"))
    return rates.groupBy("rank", *key, "grp", "kind", "key").agg(F.sum("ppm").alias("ppm"))


def worst_reasons(rows: DataFrame, kind: str = "W", offset: int = 1, defects: int = 5, reasons: int = 20) -> DataFrame:
    """The reasons with the highest sum of their worst defects' rates, each with ``defects`` numbered rows, padded with blanks.

    Rates are of a reference period; only defects that the newest period has, too, count. Blank reasons and Unknown are
    left out. Columns: reason_rank, reason, total_ppm, number, process_type, process, ng, ppm.
    """
    current = _in_period(rows, kind, 0).where("ng_qty > 0").select("reason", *DEFECT).distinct()
    each = _in_period(rows, kind, offset).groupBy("reason", *DEFECT).agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("ppm"))
    best = top_by(each.join(current, ["reason", *DEFECT], "left_semi"), "reason", defects, "ppm", DEFECT)
    names = each.where("trim(reason) <> '' and reason <> 'Unknown'").select("reason").distinct()
    totals = names.join(best.groupBy("reason").agg(F.sum("ppm").alias("total_ppm")), "reason", "left").fillna(0.0, ["total_ppm"])
    chosen = top(totals, reasons, "total_ppm", ["reason"]).withColumnRenamed("rank", "reason_rank")
    padded = chosen.select("*", F.explode(F.sequence(F.lit(1), F.lit(defects))).alias("number"))
    return padded.join(best.withColumnRenamed("rank", "number"), ["reason", "number"], "left").fillna("", DEFECT)


def worst_by_reason(rows: DataFrame, kind: str = "W", offset: int = 1, n: int = 10) -> DataFrame:
    """Every reason's ``n`` combinations with the highest rate of the reference period; reasons are ranked by their total.

    All combinations that ever occur count, with a rate of 0 where the period has none.
    """
    combos = rows.where("reason <> ''").select("reason", *DEFECT).distinct()
    each = _in_period(rows, kind, offset).groupBy("reason", *DEFECT).agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("ppm"))
    found = combos.join(each, ["reason", *DEFECT], "left").fillna(0.0, ["ppm"])
    totals = found.groupBy("reason").agg(F.sum("ppm").alias("total_ppm"))
    ranked = totals.withColumn("reason_rank", F.row_number().over(Window.orderBy(F.desc("total_ppm"), "reason")))  # a row a reason
    return top_by(found, "reason", n, "ppm", DEFECT).join(ranked, "reason")


def numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``no``: the place of each distinct ``key`` by process rank and names, from 1; the distinct keys alone are ranked."""
    names = rows.select(*key).distinct()
    at = Window.orderBy(process_rank(F.col("process_type")), *key[1:], key[0])
    return rows.join(names.withColumn("no", F.row_number().over(at)), key)


def quantities_by_day(rows: DataFrame, by: list[str], measure: str, days: list[str]) -> DataFrame:
    """Whole sums of ``measure`` with a column for each day (yyyy-MM-dd); rows without any in these days are left out."""
    here = rows.where(F.date_format("day", "yyyy-MM-dd").isin(days) & (F.col(measure) > 0))
    cells = [F.coalesce(F.sum(F.when(F.col("day") == F.lit(d).cast("date"), F.col(measure))), F.lit(0)).cast("long").alias(f"d{d.replace('-', '')}") for d in days]
    found = here.groupBy(*by).agg(*cells)
    return found.where(F.greatest(*[F.col(f"d{d.replace('-', '')}") for d in days], F.lit(0)) > 0)


def mean_of_means(rows: DataFrame, by: list[str], member: str, group: str) -> DataFrame:
    """Mean over groups of the mean over members of their positive rates; 0 where none is."""
    each = rows.groupBy(*by, group, member).agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("ppm"))
    positive = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    members = each.groupBy(*by, group).agg(F.coalesce(positive("ppm"), F.lit(0.0)).alias("mean_ppm"))
    return members.groupBy(*by).agg(F.coalesce(positive("mean_ppm"), F.lit(0.0)).alias("mean_ppm"))


def export_rows(rows: DataFrame, by: list[str], measure: str = "ppm") -> DataFrame:
    """Rows of a report as they are printed: numbered by process rank and names, rates of 0 left blank."""
    return numbered(rows, by).withColumn(measure, F.nullif(measure, F.lit(0.0)))


def nested_groups(items: DataFrame, separator: str = "\x1f") -> DataFrame:
    """A row for each group of a path table with its tree: materials, below them named sub-groups of any depth down to
    line shifts, as arrays of (material, path, line_shifts) in the order of arrival.

    ``items`` have grp, material, path, line_shift, rid. A blank material is the line shift's part before its last
    underscore, or all of it; a blank path is one unnamed sub-group.
    """
    rows = items.select("grp", material_of(F.col("material"), F.col("line_shift")).alias("material"), F.split(F.coalesce("path", F.lit("")), separator).alias("path"), "line_shift", "rid")
    leaves = rows.groupBy("grp", "material", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rid", "line_shift"))), lambda x: x["line_shift"]).alias("line_shifts"), F.min("rid").alias("rid"))
    each = leaves.groupBy("grp", "material").agg(F.array_sort(F.collect_list(F.struct("rid", "path", "line_shifts"))).alias("nodes"), F.min("rid").alias("rid"))
    node = lambda x: F.struct(x["path"].alias("path"), x["line_shifts"].alias("line_shifts"))
    materials = each.select("grp", F.struct("rid", "material", F.transform("nodes", node).alias("sub_groups")).alias("m"))
    top_level = materials.groupBy("grp").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return top_level.select("grp", F.transform("ms", lambda m: F.struct(m["material"].alias("material"), m["sub_groups"].alias("sub_groups"))).alias("materials"))


def memberships(tree: DataFrame, separator: str = "\x1f") -> DataFrame:
    """grp, line_shift for every name that a line shift belongs to: its group, its material, each sub-group by its whole
    path, and itself. ``tree`` has grp, material, path, line_shift."""
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), separator), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(" / ", F.col("grp"), F.col("material"), F.array_join(F.slice(parts, 1, n), " / ")))).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(F.array(F.col("grp"), F.concat_ws(" / ", "grp", "material"), F.col("line_shift")), prefixes))
    return tree.select(F.explode(names).alias("name"), "line_shift").distinct()
