"""Joins of intervals that overlap, as equi-joins on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's bins are this many times as wide as those of the one below; intervals above the last stay in it.
WIDER, LEVELS = 16, 8


def _placed(rows: DataFrame, span: tuple[Column, Column], width: int, side: str) -> DataFrame:
    """``rows`` as a struct with its ends as numbers, and its own level: the first at which it lies in two bins at most."""
    low, high = (c.cast("long") for c in span)
    placed = rows.select(F.struct(*rows.columns).alias(side), low.alias(f"{side}_start"), high.alias(f"{side}_end")).dropna(subset=[f"{side}_start", f"{side}_end"])
    length = F.abs(F.col(f"{side}_end") - F.col(f"{side}_start"))
    level = F.lit(LEVELS - 1)
    for n in range(LEVELS - 2, -1, -1):
        level = F.when(length <= width * WIDER**n, n).otherwise(level)
    return placed.withColumn(f"{side}_level", level)


def _binned(placed: DataFrame, side: str, other_levels: list[int], width: int) -> DataFrame:
    """A row for each bin of an interval's own level and of those above it that the other side has."""
    own = F.col(f"{side}_level")
    levels = F.filter(F.array(*[F.lit(n) for n in range(LEVELS)]), lambda n: (n == own) | ((n > own) & F.array_contains(F.array(*[F.lit(x) for x in other_levels] or [F.lit(-1)]), n)))
    wide = F.element_at(F.array(*[F.lit(width * WIDER**n).cast("long") for n in range(LEVELS)]), F.col("level") + 1)
    low, high = (F.floor(f(f"{side}_start", f"{side}_end") / wide) for f in (F.least, F.greatest))
    each = placed.withColumn("level", F.explode(levels)).withColumn(f"{side}_first", low)
    return each.withColumn("bin", F.explode(F.sequence(F.col(f"{side}_first"), high)))


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int) -> DataFrame:
    """``left`` and ``right`` (structs of their columns) of every pair with left end >= right start and left start <= right end.

    Spans are whole numbers, as days or seconds, both ends included. An interval stands in the bins it covers, whose
    width grows with its length, so that none is copied more than some times a level; a pair meets at the wider one's
    level and is kept in the first bin that both are in. ``width`` is a common length and doesn't change the result.
    Rows without both ends overlap nothing.
    """
    a, b = _placed(left, left_span, width, "left"), _placed(right, right_span, width, "right")
    levels = [sorted(r[0] for r in side.select(f"{name}_level").distinct().collect()) for side, name in ((a, "left"), (b, "right"))]  # LEVELS numbers at most
    met = _binned(a, "left", levels[1], width).join(_binned(b, "right", levels[0], width), ["level", "bin"])
    here = (F.col("level") == F.greatest("left_level", "right_level")) & (F.col("bin") == F.greatest("left_first", "right_first"))
    return met.where(here & (F.col("left_end") >= F.col("right_start")) & (F.col("left_start") <= F.col("right_end"))).select("left", "right")


def overlap_totals(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int, value: str) -> DataFrame:
    """``left`` with ``n`` and ``lowest``: how many rows of ``right`` overlap it and their smallest ``value``; rows that overlap none are left out.

    Rows of one span overlap the same others, so pairs are made of the distinct spans of both sides only, and each
    stands for all its rows: days or hours repeat however many rows there are, and no pair of rows is written out.
    """
    named = lambda span: [c.cast("long").alias(n) for c, n in zip(span, ("_low", "_high"), strict=True)]
    ends = (F.col("_low"), F.col("_high"))
    many = right.select(*named(right_span), F.col(value).alias("_value")).groupBy("_low", "_high").agg(F.count("*").alias("_n"), F.min("_value").alias("_lowest"))
    spans = left.select(*named(left_span)).distinct()
    pairs = overlapping(spans, many, ends, ends, width)
    totals = pairs.groupBy("left._low", "left._high").agg(F.sum("right._n").alias("n"), F.min("right._lowest").alias("lowest"))
    return left.withColumns(dict(zip(("_low", "_high"), (c.cast("long") for c in left_span), strict=True))).join(totals, ["_low", "_high"]).drop("_low", "_high")
