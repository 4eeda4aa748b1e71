"""Defect rates. Where a rate is rounded differs between reports, so each has its own function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.measures import ppm, ppm_unrounded
from gaugeworks.operators.ranking import top_by


def combo_ppm(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rate of the summed quantities of each combination."""
    return rows.groupBy(*by).agg(ppm(F.sum("ng_qty"), F.sum("input")).alias("ppm"))


def summed_ppm(rows: DataFrame, combo: list[str], by: list[str]) -> DataFrame:
    """Sum of the combinations' rounded rates: not the rate of the sums."""
    return combo_ppm(rows, combo).groupBy(*by).agg(F.sum("ppm").alias("ppm"))


def with_total(rows: DataFrame, combo: list[str], group: str, by: list[str]) -> DataFrame:
    """``summed_ppm`` and, for each other key, a TOTAL row over the ones that have a ``group``: grouping sets of one pass."""
    each = combo_ppm(rows.where(F.col(group) != ""), combo)
    keys = [F.col(c) for c in by]
    sets = each.groupingSets([[F.col(group), *keys], keys], F.col(group), *keys)
    return sets.agg(F.sum("ppm").alias("ppm"), F.grouping(group).alias("_all")).withColumn(group, F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(group))).drop("_all")


def quantities(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("input").alias("input"), F.sum("ng_qty").alias("ng_qty"))


def max_then_sum(rows: DataFrame, inner: list[str], by: list[str]) -> DataFrame:
    """Input counts once for each inner key (its largest), defects add up."""
    each = rows.groupBy(*inner).agg(F.sum("input").alias("i"), F.sum("ng_qty").alias("n"))
    middle = [c for c in inner if c != "ng"]
    return each.groupBy(*middle).agg(F.max("i").alias("i"), F.sum("n").alias("n")).groupBy(*by).agg(F.sum("i").alias("input"), F.sum("n").alias("ng_qty"))


def group_table(rows: DataFrame, by: list[str], first: list[str], rid: str = "rid") -> DataFrame:
    """Summed quantities; other columns from the first arrival."""
    return rows.groupBy(*by).agg(F.sum("input").alias("input"), F.sum("ng_qty").alias("ng_qty"), *[F.min_by(c, rid).alias(c) for c in first])


def recombined(rows: DataFrame, chosen: list[str], combo: list[str], by: list[str]) -> DataFrame:
    """Rates of chosen groups together, unrounded, summed over combinations."""
    each = rows.where(F.col("grp").isin(chosen)).groupBy(*combo).agg(ppm_unrounded(F.sum("ng_qty"), F.sum("input")).alias("ppm"))
    return each.groupBy(*by).agg(F.sum("ppm").alias("ppm"))


AGGREGATE = "trim(coalesce(defect_type, '')) = ''"


def weighted_pct(measurements: DataFrame, by: list[str]) -> DataFrame:
    """Defects in percent of the input over the aggregate rows (those without a defect kind); none without input."""
    sums = measurements.where(AGGREGATE).groupBy(*by).agg(F.sum("ng_total").alias("ng"), F.sum("input").alias("input"))
    return sums.where("input > 0").select(*by, (F.col("ng") * 100.0 / F.col("input")).alias("pct"))


def best_and_worst(measurements: DataFrame, by: str) -> DataFrame:
    """The tested variables with the lowest and highest mean rate of each ``by``, of at least two conditions.

    A condition's rates are added one after the other in one task, as SQL does: sums of parts round otherwise, and then
    conditions with equal rates change places. A condition has few rows, so adding up parts first would spare little.
    """
    tests = measurements.where(AGGREGATE).where(F.lower("variable_group") == "test")
    condition = [by, "variable", "variable_detail"]
    each = tests.select(*condition, "ng_rate").repartition(*condition).groupBy(*condition).agg(F.avg("ng_rate").alias("p"))
    order = F.struct("p", "variable", "variable_detail")
    found = each.groupBy(by).agg(F.count("*").alias("n"), F.min_by("variable", order).alias("best"), F.max_by("variable", order).alias("worst"))
    return found.where("n >= 2").drop("n")


def defect_summary(measurements: DataFrame, by: str, n: int = 5) -> DataFrame:
    """A line for each ``by``: its highest rate and its ``n`` most frequent defects."""
    named = measurements.where(f"not ({AGGREGATE}) and defect_count > 0").groupBy(by, "defect_type").agg(F.sum("defect_count").alias("n"))
    best = top_by(named, by, n, "n", ["defect_type"])
    each = F.transform(F.array_sort(F.collect_list(F.struct("rank", "defect_type", "n"))), lambda x: F.concat(x["defect_type"], F.lit("("), x["n"].cast("string"), F.lit(")")))
    lists = best.groupBy(by).agg(F.array_join(each, ", ").alias("l"))
    rates = measurements.groupBy(by).agg(F.max("ng_rate").alias("r"))
    line = F.concat(F.lit("maxNgRate="), F.format_string("%.1f", "r"), F.lit("%, topDefects=["), F.coalesce("l", F.lit("none")), F.lit("]"))
    return rates.join(lists, by, "left").select(by, line.alias("summary"))
