"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group with more than one part in HOT_PARTS of all rows is hot, so at most HOT_PARTS groups are.
HOT_PARTS = 1000
#: Bytes of a batch for a Python worker.
BATCH_BYTES = 4 << 20
#: Rows of a key that one task joins whatever their part in all.
SMALL = 200
#: Keys that ``pick`` and ``omit`` broadcast at most (some 20 MB); more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def free(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores added until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one call, each deleted once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)
        self.places: dict[int, str] = {}
        self.made = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        place = f"{self.path}/{name}-{self.made}"
        self.made += 1
        df.write.parquet(place)
        found = self.spark.read.schema(df.schema).parquet(place)
        self.places[id(found)] = place
        found._scratch = self  # the place is known as long as the table is
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``table`` gave."""
        for df in tables:
            delete(self.spark, self.places.pop(id(df)))

    def clear(self) -> None:
        """Delete all that is left; nothing made of the tables may be read later."""
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python workers have about BATCH_BYTES, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def batches_of(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Inside, batches for Python workers have about ``size`` bytes; for steps that also run inside, as staged tables do."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_forget: list = []


def hold(forget) -> None:
    """Make the caches that ``forget`` empties the only ones of this Python worker, which tasks of several operators use in turn."""
    if _forget and _forget[0] is not forget:
        _forget[0]()
        pa.default_memory_pool().release_unused()
    _forget[:] = [forget]


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """Add ``place``, each row's number from 0 in a global order; ``rows`` should be a written table, as it is read twice.

    Rows are dealt by ranges of the order and sorted within them; a row's place is that in its range and the rows of the
    ranges before. Ranges are as many as the session's shuffle partitions at most, so their totals are broadcast.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    found = scratch.table(sorted_, "ranked")
    pid = F.shiftright("_at", 33)
    ahead = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy(pid.alias("_pid")).count().select("_pid", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_ahead"))
    placed = found.withColumn("_pid", pid).join(F.broadcast(totals), "_pid")
    return placed.withColumn("place", F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_pid", "_at", "_ahead")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Attach to each row the row of its group, though one group may hold a third of all rows.

    ``groups`` has one short row per ``key`` with its number of rows in ``size``; together they hold ``total`` rows.
    Groups over ``total / HOT_PARTS`` rows are at most HOT_PARTS, so they are broadcast if there are any; the rest is
    joined by a shuffle in which no key is hot.
    """
    limit = total // HOT_PARTS
    hot = groups.where(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups.hint("merge"), key)
    hot, cold = F.broadcast(hot), groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key))


def join_spread(rows: DataFrame, table: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """Join ``rows``, at most ``total``, with the one row of ``table`` for each ``key``; that row may be long.

    Keys with over ``total / HOT_PARTS`` rows, of which there are fewer than HOT_PARTS, are dealt by the column ``by``
    over as many parts as they need, and the table's row is copied to each part; only those keys and numbers are
    broadcast, if there are any.
    """
    limit = max(1, total // HOT_PARTS)
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(limit, SMALL))
    if hot.isEmpty():
        return rows.join(table.hint("merge"), key)
    parts = F.broadcast(hot.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    many = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), many).cast("int")).drop("_parts")
    copies = table.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts")
    return dealt.join(copies.hint("merge"), [key, "_part"]).drop("_part")


def _few(keys: DataFrame) -> DataFrame:
    """``keys`` with a broadcast if they are few, else with a sort-merge join."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")


def pick(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose columns ``by`` are in the staged table ``keys``; null equals null."""
    return _chosen(rows, keys, by, "left_semi")


def omit(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose columns ``by`` aren't in the staged table ``keys``; null equals null."""
    return _chosen(rows, keys, by, "left_anti")


def _chosen(rows: DataFrame, keys: DataFrame, by: list[str], how: str) -> DataFrame:
    names = free(rows, *[f"_of_{i}" for i in range(len(by))])
    right = _few(keys.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return rows.join(right, same, how)
