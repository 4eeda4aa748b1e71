"""Importance resampling of documents towards a target distribution, on hashed runs of words.

Texts become blocks of a sparse document-by-bucket matrix of counts, each block a row of a written table in compressed
sparse row form: the documents, where each one's cells begin, and the cells' buckets and counts. Column sums of the
blocks give the two distributions, their logarithmic ratio a gain for each bucket, and the product of the matrix with
the vector of gains every document's weight. Gumbel noise from a hash of doc_id is added, and the highest scores are
drawn, which samples without replacement in proportion to exp(weight / 1000).

Defined cases: a null or wordless text has no features and weight 0; a null doc_id draws its noise as the empty text;
repeated rows are scored and ranked each; an empty table gives no rows, and an empty target flat gains; other columns
are ignored. Texts are read in slices, so that a long one needs no more than its own words' buckets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, batches_of, documents, ranked, stage

BUCKETS = 10_000
SEED = 2024
#: Words that a document needs to be drawn, and the part of such documents that is drawn, in hundredths.
LEAST_WORDS, PERCENT = 20, 10
#: Cells and documents after which a block ends (some 500 kB), and bytes of a text read at once.
CELLS, DOCUMENTS, SLICE = 50_000, 1000, 1 << 20
#: Words in lower-cased UTF-8: digits, letters and everything beyond ASCII.
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
MATRIX = "doc_ids array<bigint>, words array<bigint>, features array<bigint>, starts array<int>, buckets array<int>, counts array<int>"


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice."""
    data, at = (text or "").encode().lower(), 0
    while at < len(data):
        gap = GAP.search(data, at + SLICE)
        stop = gap.start() if gap else len(data)
        yield WORD.findall(data, at, stop)
        at = stop


def cells(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words of a text, and the buckets and counts of its runs of one to ``longest`` words."""
    total, tail, found = 0, [], []
    for words in words_of(text):
        total += len(words)
        joined = tail + words
        found.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets)
        for n in range(2, longest + 1):
            ends = range(max(n, len(tail) + 1), len(joined) + 1)  # runs that end in this slice
            found.append(np.array([zlib.crc32(b" ".join(joined[e - n : e])) % buckets for e in ends], np.uint32))
        tail = joined[len(joined) - longest + 1 :] if longest > 1 and len(joined) >= longest else joined if longest > 1 else []
    at, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return total, at.astype(np.int32), count.astype(np.int32)


def matrix(texts: DataFrame, key: str, longest: int, buckets: int) -> DataFrame:
    """Blocks of the count matrix of ``texts``, whose rows are named by the column ``key``."""

    def block(rows: list) -> pa.RecordBatch:
        ids, words, at, counts = zip(*rows, strict=True)
        starts = np.cumsum([0, *map(len, at)])
        columns = [ids, words, [int(c.sum()) for c in counts], starts, np.concatenate(at), np.concatenate(counts)]
        names = [c.split()[0] for c in MATRIX.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3
        return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(t)) for c, t in zip(columns, kinds, strict=True)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                held.append((doc_id, *cells(text.as_py(), longest, buckets)))
                size += len(held[-1][2])
                if size >= CELLS or len(held) >= DOCUMENTS:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return texts.select(F.col(key).cast("long"), "text").mapInArrow(rows, MATRIX)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; a task sends one number a bucket, and the driver gets as many."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch["buckets"].flatten().to_numpy(), batch["counts"].flatten().to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("buckets", "counts").mapInArrow(rows, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target by that in the corpus, rounded down."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the product of the matrix with the vector of gains."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, features, starts, buckets, counts = (batch[c][row].values for c in range(6))
                sums = np.concatenate([[0], np.cumsum(gain[buckets.to_numpy()] * counts.to_numpy())])
                at = starts.to_numpy()
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(sums[at[1:]] - sums[at[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int = SEED):
    """Thousandths of a Gumbel number from a hash of doc_id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(part)))


def resample(docs: DataFrame, target: DataFrame, target_id: str, percent: int = PERCENT, least: int = LEAST_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null where it isn't drawn."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    with batches_of(spark):
        blocks = scratch.table(matrix(docs, "doc_id", longest, buckets), "matrix")
        aims = scratch.table(matrix(target, target_id, longest, buckets), "target")
        gain = gains(column_sums(blocks, buckets), column_sums(aims, buckets))
    scored = scratch.table(weights(blocks, gain).withColumn("score", F.col("weight") + noise(seed)), "scored")
    scratch.drop(blocks, aims)
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    placed = ranked(able, [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("n_words")], scratch)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    rest = scored.where(F.col("n_words") < least).select("*", F.lit(None).cast("long").alias("rank"))
    found = stage(placed.select(*scored.columns, rank).unionByName(rest), "resampled")
    scratch.clear()
    return found


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct word by its table of 256 entries, which eight shifts of each index give.
OP11_SQL = r"""
WITH RECURSIVE shifts(i, c, n) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM shifts WHERE n < 8),
lookup AS (SELECT list(c ORDER BY i) AS entries FROM shifts WHERE n = 8),
raw AS (
  SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
aims AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
features AS (SELECT rid, unnest(words) AS word FROM raw),
counted AS (SELECT rid, word, count(*) AS n FROM features GROUP BY ALL),
distinct_words AS (SELECT word FROM counted UNION SELECT word FROM aims),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(word) + 1), lambda x: ('0x' || substr(hex(encode(word)), 2 * x - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1]))) % 10000 AS bucket
  FROM distinct_words, lookup),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM counted JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
gained AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * (s_all + 10000) / ((s + 1.0)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weighed AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM counted JOIN hashed USING (word) JOIN gained USING (bucket) GROUP BY rid),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM raw LEFT JOIN weighed USING (rid)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""
