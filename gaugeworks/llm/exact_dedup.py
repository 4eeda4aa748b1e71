"""Exact dedup against a persistent digest index.

The index is a folder with one row per distinct text (digest, keep_id, batch), bucketed and sorted by digest. Data come
in batches: a batch is reduced to one row per digest, dropped by a sort-merge anti-join where the index has them, and
the rest is appended. The index is all that lasts: any later session opens it by its path, and a batch that is given
again under its name, as after a failure, gets the verdicts it got before.

Defined cases: a null text counts as empty; empty texts are equal to each other; white space runs count as one
space (not trimmed); null doc_ids never win over others (a group of nulls alone keeps null); repeated rows of one
doc_id and text are one document and share its verdict (``deduplicate`` returns one of them); an empty table
gives no rows; other columns are carried by ``deduplicate`` under any name, as its own are prefixed.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, documents, free, join_groups, new_path, omit, pick, text_of

SPACES = r"[\x20\x09-\x0D]+"
BUCKETS = 64
#: Batches in which the registered query takes the table.
BATCHES = 4


def digest_of(text_col: str = "text") -> Column:
    """SHA-256 of the text with white space runs made one space, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text_col), SPACES, " "), 256))


class DigestIndex:
    """The index at a path; its number of buckets is kept beside it, so that every session reads it as it was written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            self.buckets = spark.read.parquet(f"{self.path}/about").first().buckets
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets = buckets
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.path}/about")
        self.name = f"digest_index_{zlib.crc32(self.path.encode()):08x}_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )
        spark.catalog.refreshTable(self.name)  # another session may have appended

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Append the (digest, keep_id) of which the index doesn't have the digest; one row a digest is expected."""
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # as Spark buckets rows, so that a task writes one file
        dealt = fresh.select("digest", "keep_id", F.lit(batch).alias("batch")).repartitionById(self.buckets, bucket)
        dealt.sortWithinPartitions("digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def known(self, groups: DataFrame) -> DataFrame:
        """``groups`` with the keep_id and batch that the index holds for their digests."""
        return groups.join(self.rows().hint("merge"), "digest")


def verdicts(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """doc_id, mark, digest, keep_id, group_size, kept for every row; the index takes the new digests.

    ``keep_id`` is the doc_id that the index holds for the digest: the smallest of the first batch that had it.
    ``group_size`` counts the rows of this batch. ``kept`` rows are new with this batch and have that doc_id. ``batch``
    names the batch, and a new name is taken if there is none. ``mark`` is a hash of the text as it is.
    """
    batch, scratch = batch or uuid.uuid4().hex, Scratch(docs.sparkSession, "exact")
    rows = scratch.table(docs.select("doc_id", F.xxhash64(text_of()).alias("mark"), digest_of().alias("digest")), "digests")
    groups = scratch.table(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    index.append(groups, batch)
    found = join_groups(rows, index.known(groups.drop("keep_id")), "digest", "group_size", rows.count())
    return found.select("doc_id", "mark", "digest", "keep_id", "group_size", ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each text that the index (by default an empty
    one) didn't have before this batch.

    Rows that go are named by doc_id and mark and left out; where one doc_id has a text in several spellings of its
    white space, the smallest mark stays, and repeated rows are folded to one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    index = index or DigestIndex(spark, new_path(spark, "digest-index"))
    found = verdicts(docs, index, batch)
    each = found.groupBy("digest", "doc_id", "kept", "mark").agg(F.count("*").alias("n"))
    spellings = each.where("kept")  # of each text those of one doc_id, so that no join has all copies of a text
    ends = spellings.groupBy("digest").agg(F.min("mark").alias("first"))
    stays = F.col("mark") == F.col("first")
    marked = spellings.join(ends.hint("merge"), "digest").where(~stays | (F.col("n") > 1))
    one, mark = by = free(docs, "exact_id", "exact_mark")
    named = (F.col("doc_id").alias(one), F.col("mark").alias(mark))
    out = scratch.table(each.where("not kept").select(*named, F.lit(False).alias("again")).unionByName(marked.select(*named, stays.alias("again"))), "out")
    own, columns = docs.select("*", F.col("doc_id").alias(one), F.xxhash64(text_of()).alias(mark)), [F.col(f"`{c}`") for c in docs.columns]
    once, again = omit(own, out, by).select(*columns), out.where("again")
    if again.isEmpty():
        return once
    folded = pick(own, again, by).groupBy(*by).agg(F.first(F.struct(*columns)).alias("row"))  # the rows of one text
    return once.unionByName(folded.select("row.*"))


def verdicts_of_batches(docs: DataFrame, index: DigestIndex, batches: int = BATCHES) -> DataFrame:
    """The verdicts over a whole table that comes in batches of ascending doc_id (nulls in the last), over one index.

    Each batch is deduplicated against what the ones before have left in the index; ``group_size`` counts all rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.table(docs.select("doc_id", digest_of().alias("digest")), "digests")
    bounds = rows.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or []  # a few numbers
    edges = sorted(set(bounds))
    number = sum((F.coalesce(F.col("doc_id") > edge, F.lit(True)).cast("int") for edge in edges), F.lit(0))
    groups = scratch.table(rows.groupBy("digest", number.alias("number")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")), "groups")
    for i in range(len(edges) + 1):
        index.append(groups.where(F.col("number") == i), f"batch-{i}")
    sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
    found = join_groups(rows, index.known(sizes), "digest", "group_size", rows.count())
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdicts_of_batches(documents(spark, sf_dir), DigestIndex(spark, new_path(spark, "digest-index")))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
