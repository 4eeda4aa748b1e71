"""Rankings and fills. Ties are broken by explicit columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reference_period(keys: DataFrame, column: str = "key") -> DataFrame:
    """The second-newest key, or the newest if there is only one: one row."""
    newest = keys.select(column).distinct().orderBy(F.desc(column)).limit(2)
    return newest.agg(F.min(column).alias(column))


def in_reference(rows: DataFrame) -> DataFrame:
    """Rows of the reference week; to be taken before rates are made of them."""
    weeks = rows.where("kind = 'W'")
    return weeks.join(F.broadcast(reference_period(weeks)), "key", "left_semi")  # one row


def top(rows: DataFrame, n: int, measure: str, ties: list[str]) -> DataFrame:
    """The n rows with the largest measure, numbered."""
    best = rows.orderBy(F.desc(measure), *ties).limit(n)  # a sort of n rows for each task
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(measure), *ties)))


def latest(rows: DataFrame, order: str, ties: list[str], n: int = 1) -> DataFrame:
    """The ``n`` rows that come last by ``order``."""
    return rows.orderBy(F.desc(order), *ties).limit(n)


def top_by(rows: DataFrame, group: str, n: int, measure: str, ties: list[str]) -> DataFrame:
    at = Window.partitionBy(group).orderBy(F.desc(measure), *ties)
    return rows.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= n)


def newest(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows of the newest periods of each kind; the distinct periods alone are ranked, and only ``limits`` are broadcast."""
    keys = rows.select("kind", "key").distinct()
    keys = keys.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("key"))))
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    few = keys.where(F.col("_n") <= F.element_at(most, F.col("kind"))).drop("_n")
    return rows.join(F.broadcast(few), ["kind", "key"], "left_semi")


def fill(rows: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """Blanks take the last value before them, leading ones the first after."""
    at = Window.partitionBy(group).orderBy(order)
    before = F.last(column, True).over(at.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, True).over(at.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(column, F.coalesce(before, after))


def islands(days: DataFrame, column: str = "day", by: tuple[str, ...] = ()) -> DataFrame:
    """Runs of consecutive dates as first and last day, of each ``by``; distinct days are what is ordered."""
    at = Window.partitionBy(*by).orderBy(column)
    run = F.date_sub(F.col(column), F.row_number().over(at))
    found = days.select(*by, column).distinct().withColumn("_run", run).groupBy(*by, "_run")
    return found.agg(F.min(column).alias("first_day"), F.max(column).alias("last_day")).drop("_run")
