"""Files as rows: an index with hashes of their heads and tails, and files that are the same.

Spark lists the files; their bytes are read by ranges inside tasks, so that a file is never loaded whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.sources import writers

#: The part of a file's bytes that is hashed at each end, and bytes read at once.
ENDS, PIECE = 0.10, 1 << 20
KEY = ["path", "bytes", "modified"]


@contextmanager
def tasks_of_listing(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark lists folders in as many tasks as shuffles have, where by itself it takes one for each folder up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, name, directory, bytes, modified of all files under ``path``; none is opened. Spark's scans pass over empty files.

    The scan has a task for some thirty files; they are put together to as many tasks as shuffles have.
    """
    with tasks_of_listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = F.element_at(F.split("path", "/"), -1)
    directory = F.regexp_replace("path", "/[^/]*$", "")
    return files.select("path", name.alias("name"), directory.alias("directory"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def ranges_of(size: int, whole: bool) -> list[tuple[int, int]]:
    """(start, length) of what is hashed: the first and last tenth, rounded up, or everything where these would meet."""
    sample = max(1, math.ceil(size * ENDS))
    if size <= 0:
        return []
    return [(0, size)] if whole or 2 * sample >= size else [(0, sample), (size - sample, sample)]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, which is the cluster's own where a plain path names none, as for Spark's writers."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, of those that pyarrow knows, and the place in it."""
    scheme, authority, place = re.fullmatch(r"([A-Za-z][\w+.-]*):(?://([^/]*))?(/.*)", path, re.DOTALL).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), place
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return system, root.rstrip("/") + place


def opened(path: str) -> pa.NativeFile:
    system, place = located(path)
    return system.open_input_file(place)


def write_each(rows: DataFrame, path: str) -> None:
    """A text file at ``path``/``place`` for each distinct ``place`` of ``rows``, which holds a line ``value`` for each of its rows.

    Tasks write the files themselves under a name of their own and move them when they are whole, so the driver moves
    none, and a task that runs again replaces its files. Places are dealt over the tasks and sorted, so that a place's
    lines are written one after the other.
    """
    path = qualified(rows.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(path)
        attempt = f".part-{uuid.uuid4().hex}"
        pairs = (pair for batch in batches for pair in zip(batch["place"].to_pylist(), batch["value"].to_pylist(), strict=True))
        for place, lines in groupby(pairs, itemgetter(0)):
            folder, _, name = f"{root}/{place}".rpartition("/")
            system.create_dir(folder)
            with system.open_output_stream(f"{folder}/{attempt}") as file:
                for _, value in lines:
                    file.write((value or b"") + b"\n")
            system.move(f"{folder}/{attempt}", f"{folder}/{name}")
        yield from ()

    rows.select("place", F.col("value").cast("binary")).repartition("place").sortWithinPartitions("place").mapInArrow(write, "place string").write.format("noop").mode("overwrite").save()


def hashed(files: DataFrame, whole: bool = False, known: str | None = None) -> DataFrame:
    """Add ``hash``, the SHA-256 of a file's ends (or of all of it) in upper case, and ``bytes_read``.

    ``files`` have path and bytes. Both are null for a file that can't be read, as when it is gone by now. A file that has
    a hash in the column ``known`` keeps it and isn't opened.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            before = batch[known].to_pylist() if known else [None] * len(batch)
            for path, size, own in zip(batch["path"].to_pylist(), batch["bytes"].to_pylist(), before, strict=True):
                if own is not None:
                    found.append((own, 0))
                    continue
                digest, read = hashlib.sha256(), 0
                try:
                    with opened(path) as file:
                        for start, length in ranges_of(size, whole):
                            for at in range(start, start + length, PIECE):
                                part = file.read_at(min(PIECE, start + length - at), at)
                                digest.update(part)
                                read += len(part)
                    found.append((digest.hexdigest().upper(), read))
                except OSError:
                    found.append((None, None))
            for name, at, kind in (("hash", 0, pa.string()), ("bytes_read", 1, pa.int64())):
                batch = batch.append_column(name, pa.array([f[at] for f in found], kind))
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(rows, f"{schema}, hash string, bytes_read bigint")


def file_index(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """``listing`` with hash, bytes_read and ``reused``: files with the path, size and time of one in ``known`` keep its
    hash and aren't opened. Files that can't be read are left out."""
    files = listing(spark, path)
    if known is None:
        return hashed(files).where("hash is not null").withColumn("reused", F.lit(False))
    before = known.select(*KEY, F.col("hash").alias("known"))
    found = hashed(files.join(before, KEY, "left"), known="known").where("hash is not null")
    return found.withColumn("reused", F.col("known").isNotNull()).drop("known")


def same_files(index: DataFrame) -> DataFrame:
    """path, bytes, hash, first_path, copies of files with equal content.

    Candidates agree in size and in the hash of their ends; only these are read whole. Both hashes are written to scratch
    tables, as each is used twice and no file should be read again for that.
    """
    index = writers.staged(index.select("path", "bytes", "hash"), "index")
    groups = index.groupBy("bytes", "hash").count().where("count > 1")
    candidates = index.join(groups, ["bytes", "hash"], "left_semi").select("path", "bytes").repartition("path")
    whole = writers.staged(hashed(candidates, whole=True).where("hash is not null").select("path", "bytes", "hash"), "whole")
    same = whole.groupBy("bytes", "hash").agg(F.min("path").alias("first_path"), F.count("*").alias("copies")).where("copies > 1")
    return whole.join(same, ["bytes", "hash"])
