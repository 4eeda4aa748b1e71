"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's target over its size. Documents are
put in one global order, by source, size (longest first) and a hash; a document's place in its source times the
expected copies is the prefix sum of them. One pseudo-random offset a source is added, and a document is emitted once
for each integer boundary between its own prefix sum and the next. As sizes fall along the order, what a source
gives differs from its target by less than its longest document.

Targets are found by water-filling: a level for each unit of weight is raised until the sources under their cap take
what the capped ones leave, one small aggregate over the sources a step.

Defined cases: a null text has size 0 and may be emitted; null is a source of its own, the last, and differs from the
empty one; null doc_ids hash as the empty text; repeated rows are documents of their own; an empty table gives no rows,
and a source without words is never taken; if all targets reach their caps, the rest of the share isn't given out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, documents, free, join_groups, ranked, stage, text_of

WEIGHTS = (3, 1, 2)
#: What the mix takes of all sizes, and the most it takes of a source's.
SHARE, CAP = 1.5, 2.0
SEED = 2024


def _hash(*parts: Column) -> Column:
    """32 bits of a hash of ``parts``, joined by colons; null as the empty text."""
    joined = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target`` to ``sources`` (``weight`` and ``source_size``, one row each).

    ``level`` is what a unit of weight gets. A source whose cap is below its weight's part is full; the others share
    what is left, which raises the level and may fill more, until none is above.
    """
    most = cap * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        full = most < F.col("weight") * F.lit(level)
        capped, free_weight = sources.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not free_weight:
            return sources.withColumn("target", most)
        left = share * total - (capped or 0.0)
        before, level = level, left / free_weight
    full = most < F.col("weight") * F.lit(before)
    return sources.withColumn("target", F.when(full, most).otherwise(F.col("weight") * F.lit(left) / F.lit(float(free_weight))))


def copies(docs: DataFrame, scratch: Scratch, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, and the columns ``keep`` as a struct ``row``, of every row of ``docs``."""
    words = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = docs.select("doc_id", key.alias("key"), words.alias("size"), _hash(F.col("doc_id")).alias("h"), *([F.struct(*keep).alias("row")] if keep else []))
    placed = ranked(scratch.table(rows, "sizes"), [F.asc("key"), F.desc("size"), F.asc("h"), F.asc("doc_id")], scratch)
    sources = scratch.table(placed.groupBy("key").agg(F.sum("size").alias("source_size"), F.min("place").alias("first"), F.count("*").alias("n")), "sources")
    numbered = ranked(sources, [F.asc("key")], scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    aimed = scratch.table(targets(numbered.withColumn("weight", weight).drop("place"), share, cap), "targets")
    offset = (_hash(F.substring("key", 2, 1 << 30)) % 65536 + 0.5) / 65536
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    found = join_groups(placed, aimed.select("key", "source_size", "target", "first", "n", offset.alias("offset"), each.alias("each")), "key", "n", placed.count())
    at = F.col("place") - F.col("first")
    crossed = F.floor((at + 1) * F.col("each") + F.col("offset")) - F.floor(at * F.col("each") + F.col("offset"))
    return found.select("doc_id", "size", "source_size", "target", crossed.alias("copies"), *(["row"] if keep else []))


def mix(docs: DataFrame, **law) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with its number in a further column ``copy``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    taken = copies(docs, scratch, tuple(docs.columns), **law).where("copies > 0")
    name = free(docs, "copy")[0]
    found = stage(taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name)), "mix")
    scratch.clear()
    return found


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    found = stage(copies(documents(spark, sf_dir), scratch).select("doc_id", "size", "source_size", "target", taken), "mixed")
    scratch.clear()
    return found


#: The capped sources are those that, in the order of their caps by weight, lie under the level of all from them on.
OP12_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY source),
ahead AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS share,
    coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS others
  FROM sources WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, most < weight * ((share - caps) / others) AS is_full FROM ahead),
free AS (
  SELECT coalesce(sum(most) FILTER (is_full), 0) AS capped, sum(weight) FILTER (NOT is_full)::DOUBLE AS weights FROM judged),
aimed AS (
  SELECT source, source_size, CASE WHEN is_full THEN most ELSE weight * (share - capped) / weights END AS target,
    (('0x' || substr(sha256('2024:' || coalesce(source, '')), 1, 8))::BIGINT % 65536 + 0.5::DOUBLE) / 65536 AS u
  FROM judged, free),
placed AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
    row_number() OVER (PARTITION BY aimed.source ORDER BY size DESC, h, doc_id NULLS FIRST) AS place
  FROM sizes JOIN aimed ON sizes.source IS NOT DISTINCT FROM aimed.source)
SELECT doc_id, size, source_size, target, (size * (floor(place * each + u) - floor((place - 1) * each + u)))::BIGINT AS taken FROM placed
"""
