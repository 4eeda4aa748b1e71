"""Period keys. Weeks have three rules, named apart; keys of weeks and months are kept apart by their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def week_first_monday(day: Column) -> Column:
    """Week 1 holds 1 January, weeks start on Monday."""
    return (F.floor((F.dayofyear(day) - 1 + F.weekday(F.trunc(day, "year"))) / 7) + 1).cast("int")


def week_first_sunday(day: Column) -> Column:
    """Week 1 holds 1 January, weeks start on Sunday."""
    return (F.floor((F.dayofyear(day) - 1 + F.dayofweek(F.trunc(day, "year")) - 1) / 7) + 1).cast("int")


def week_after_monday(day: Column) -> Column:
    """One more than the number of Mondays in the year up to the day."""
    return (F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7) + 1).cast("int")


def week_key(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lpad(week_first_monday(day).cast("string"), 2, "0"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")


def day_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


KEYS = {"D": day_key, "W": week_key, "M": month_key}


def grains(day: Column, kinds: str = "DWM") -> Column:
    """An array of (kind, key) for the day, week and month of a date; empty for a null date."""
    every = F.array(*[F.struct(F.lit(kind).alias("kind"), KEYS[kind](day).alias("key")) for kind in kinds])
    return F.filter(every, lambda p: p["key"].isNotNull())


def by_grain(facts: DataFrame, day: str = "day", kinds: str = "DWM") -> DataFrame:
    """One row for each grain, so that one aggregation serves all three."""
    return facts.withColumn("_p", F.explode(grains(F.col(day), kinds))).select("*", "_p.kind", "_p.key").drop("_p")


def shifted(kind: Column, key: Column) -> Column:
    """The key that a report names beside another: a week before, by ISO weeks at the turn of a year, or two days before."""
    year, week = F.left(key, F.lit(4)).cast("int"), F.right(key, F.lit(2)).cast("int")
    last = F.weekofyear(F.make_date(year - 1, F.lit(12), F.lit(28)))
    before = F.when(week > 1, F.concat(year.cast("string"), F.lpad((week - 1).cast("string"), 2, "0"))).otherwise(F.concat((year - 1).cast("string"), F.lpad(last.cast("string"), 2, "0")))
    days = F.date_format(F.date_sub(F.to_date(key, "yyyyMMdd"), 2), "yyyyMMdd")
    return F.when(kind == "W", before).when(kind == "D", days).otherwise(key)


def label(kind: Column, key: Column) -> Column:
    """Headers: MM/dd, W and the week number, M and the month number."""
    tail = F.right(key, F.lit(2)).cast("int").cast("string")
    return F.when(kind == "D", F.concat(F.substring(key, 5, 2), F.lit("/"), F.substring(key, 7, 2))).when(kind == "W", F.concat(F.lit("W"), tail)).otherwise(F.concat(F.lit("M"), tail))
