"""Duplicate resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import normalize


def _resolve(later: Column, earlier: Column, also: tuple[str, ...]) -> Column:
    """Of two records of a key: the larger input; at the same input the one with defects, and their sum if both have.

    Records that agree in their defects and in what ``also`` names are the same, and the later one stands.
    """
    total = F.struct(*[(later["ng_qty"] + earlier["ng_qty"] if c == "ng_qty" else later[c]).alias(c) for c in ("input", "ng_qty", "rid", *also)])
    equal = earlier["ng_qty"] == later["ng_qty"]
    for c in also:
        equal = equal & earlier[c].eqNullSafe(later[c])
    same = F.when(equal | (earlier["ng_qty"] == 0), later).when(later["ng_qty"] == 0, earlier).otherwise(total)
    return F.when(earlier["input"] > later["input"], earlier).when(earlier["input"] < later["input"], later).otherwise(same)


def fold(rows: DataFrame, key: list[str], names: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """One record a key: the pairwise rule applied from the last arrival (``rid``) to the first.

    Key columns in ``names`` are compared and given normalised, other texts trimmed. Only records with the key's largest
    input can matter: rows are dealt by a hash of the key, gathered by key and input, and of a key the list with the
    largest input is taken. Both steps work on the one shuffle, and the hash as first key makes their sorts compare
    numbers. A key's records of one input are its true duplicates, few by nature.
    """
    kinds = dict(rows.dtypes)
    keyed = rows.withColumns({c: normalize(F.col(c)) if c in names else F.trim(c) for c in key if kinds[c] == "string"})
    columns = ["input", "ng_qty", "rid", *also]
    dealt = keyed.select(F.xxhash64(*key).alias("_hash"), *key, *[c for c in columns if c not in key]).repartition("_hash")
    lists = dealt.groupBy("_hash", *key, "input").agg(F.collect_list(F.struct("rid", *[c for c in columns if c not in ("rid", "input")])).alias("r"))
    best = lists.groupBy("_hash", *key).agg(F.max(F.struct("input", "r")).alias("b"))
    record = lambda x: F.struct(*[(F.col("b.input") if c == "input" else x[c]).alias(c) for c in columns])
    records = best.select(*key, F.transform(F.reverse(F.array_sort("b.r")), record).alias("r"))
    folded = F.aggregate(F.slice("r", 2, F.size("r")), F.get("r", F.lit(0)), lambda acc, x: _resolve(acc, x, also))
    return records.select(*key, folded.alias("f")).select(*key, *[f"f.{c}" for c in columns])


def merge_repeats(rows: DataFrame, key: list[str], first: list[str], rid: str = "rid") -> DataFrame:
    """Mean input and summed defects of a key; the other columns from its first arrival."""
    return rows.groupBy(*key).agg(F.avg("input").alias("input"), F.sum("ng_qty").alias("ng_qty"), *[F.min_by(c, rid).alias(c) for c in first])


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    at = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def keep_first(rows: DataFrame, key: list[Column], order: str) -> DataFrame:
    at = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")
