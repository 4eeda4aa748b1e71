"""Contiguous shards of nearly equal bytes, cut from a global prefix sum.

Rows are range-partitioned by doc_id; each partition's total gives, through a running sum over the few totals,
the bytes before the partition, and a running sum inside it the bytes before each row. The middle of a row's bytes
decides its shard: ``floor(middle * shards / total)``, so shards are runs of the doc_id order and differ from the
equal target by less than one document.

Defined cases: a null text has no bytes and still OVERHEAD; a null doc_id comes first; rows of one doc_id are
ordered by checksum and size, and full ties are the same to the result; an empty table gives no rows; a document
larger than a target leaves shards empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, stage, text_of

SHARDS = 40
OVERHEAD = 16
ORDER = ("doc_id", "text_crc32", "size")


def prefix_sums(rows: DataFrame, size: str, order: tuple[str, ...]) -> DataFrame:
    """Add ``before`` (sizes of all earlier rows), ``place`` (number of them) and ``total``, in a global order."""
    dealt = stage(rows.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("pid").agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row for each range partition: their number is the session's number of shuffle partitions at most
    bases = totals.select(
        "pid",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base_n"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("pid").orderBy(*order)
    return (
        dealt.join(F.broadcast(bases), "pid")
        .withColumn("before", F.col("base") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
        .withColumn("place", F.col("base_n") + F.row_number().over(inside) - 1)
        .drop("pid", "base", "base_n")
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = prefix_sums(rows, "size", ORDER).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * before + size) * {shards} div (2 * total)")).cast("int"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
