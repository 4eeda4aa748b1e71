"""Stored tables with a key, dealt over parts by a hash of it, so that a change rewrites only the parts it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.sources.writers import replace_partitions

#: Parts of a table unless it was made with another number, which its later changes need, too.
PARTS = 64
PART = "part_of_key"


def _part(key: list[str], parts: int) -> Column:
    """The part of a key: keys hash as texts, whatever types the two sides have; null as a value of its own."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in key]), F.lit(parts)).cast("int")


def create(df: DataFrame, path: str, key: list[str], parts: int = PARTS) -> None:
    """Write a table; one task writes each part, so that a part is one file unless it is large."""
    df.withColumn(PART, _part(key, parts)).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {PART} int").parquet(path).drop(PART)


def change(spark: SparkSession, path: str, new: DataFrame, schema: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], parts: int = PARTS) -> list[int]:
    """Put ``merge(old, new)`` in place of the parts that the keys of ``new`` fall into; their numbers are returned.

    ``merge`` sees only the old rows of these parts. A part's files are replaced when the whole job is done, so that a
    job that fails leaves the table as it was. A part that is empty afterwards keeps its old rows: merges don't only delete.
    """
    dealt = new.withColumn(PART, _part(key, parts))
    touched = sorted(r[0] for r in dealt.select(PART).distinct().collect())  # at most ``parts``
    if touched:
        old = spark.read.schema(f"{schema}, {PART} int").parquet(path).where(F.col(PART).isin(touched)).drop(PART)
        merged = merge(old, new).withColumn(PART, _part(key, parts)).repartition(PART)
        replace_partitions(merged, path, [PART])
    return touched


def upsert(spark: SparkSession, path: str, new: DataFrame, schema: str, key: list[str], order: str, parts: int = PARTS) -> list[int]:
    """One row a key: a new one replaces the old one, and of new ones with one key the last by ``order``; null keys are equal."""
    columns = read(spark, path, schema).columns
    last = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in columns if c not in key]), order).alias("_r")).select(*key, "_r.*")
    return change(spark, path, last, schema, key, lambda old, rows: _without(old, rows, key).unionByName(rows.select(*columns)), parts)


def replace_on_key(spark: SparkSession, path: str, new: DataFrame, schema: str, key: list[str], parts: int = PARTS) -> list[int]:
    """All rows of every key of ``new`` are replaced by its rows; null keys are equal."""
    return change(spark, path, new, schema, key, lambda old, rows: _without(old, rows, key).unionByName(rows.select(*old.columns)), parts)


def _without(old: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    keys = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return old.join(keys, same, "left_anti")
