"""Token ids in directly addressable codes, written as a table of segments in ascending doc_id order.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, each further level the next
chunk of those ids that go on; a bitmap for each level says which do, and a rank directory counts the set bits before
every block of 64, so the place of an id on the next level is a rank query. Any token is read by one step a level,
without decoding others.

A segment is a run of whole documents of about SEGMENT tokens: doc_ids, their starts in the range partition, and the
codes in ``payload``. Range partitions are in doc_id order; their totals (one row each) give global starts.

Defined cases: a null text counts as empty and has the end id alone; a null doc_id comes first and stays null;
repeated doc_ids are separate documents next to each other; an empty table gives no segments; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, new_path
from gaugeworks.llm.word_tokens import encoded, vocabulary_path

END_ID = 2
SEGMENT = 1 << 18
BLOCK = 64  # ids a rank directory entry counts over
PAYLOAD = pa.schema({"pid": pa.int32(), "seq": pa.int32(), "local_start": pa.int64(), "n_tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "payload": pa.binary()})
SCHEMA = "pid int, seq int, local_start bigint, n_tokens bigint, doc_ids array<bigint>, starts array<bigint>, payload binary"


def pack_codes(ids: np.ndarray) -> bytes:
    """The codes of ``ids`` (unsigned 32-bit): number of levels, then for each its size, chunks, bitmap and ranks."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK, dtype=np.uint8)
        bits[: len(rest)] = more
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1))])
        levels.append(np.uint32(len(rest)).tobytes() + (rest & 0xFF).astype(np.uint8).tobytes() + np.packbits(bits, bitorder="little").tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return np.uint32(len(levels)).tobytes() + b"".join(levels)


class Codes:
    """Reads packed codes: one id by ``at``, all by ``all``."""

    def __init__(self, payload: bytes):
        self.levels, at = [], 4
        for _ in range(int.from_bytes(payload[:4], "little")):
            n = int.from_bytes(payload[at : at + 4], "little")
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            bitmap = np.frombuffer(payload, "<u8", blocks, at + 4 + n)
            ranks = np.frombuffer(payload, "<u4", blocks + 1, at + 4 + n + 8 * blocks)
            self.levels.append((chunks, bitmap, ranks))
            at += 4 + n + 12 * blocks + 4

    def at(self, i: int) -> int:
        """The id at place ``i``."""
        found = 0
        for depth, (chunks, bitmap, ranks) in enumerate(self.levels):
            found |= int(chunks[i]) << (8 * depth)
            word, bit = int(bitmap[i // BLOCK]), i % BLOCK
            if not word >> bit & 1:
                break
            i = int(ranks[i // BLOCK]) + (word & ((1 << bit) - 1)).bit_count()
        return found

    def all(self) -> np.ndarray:
        found = np.zeros(0, dtype=np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            more = np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(chunks)].astype(bool)
            here = chunks.astype(np.uint32)
            here[more] |= found << 8
            found = here
        return found


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encode every text, add ``end_id`` and write the segments to ``path``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, local, ids, starts, parts, n = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(parts), dtype="<u4")
            return pa.RecordBatch.from_pylist([{"pid": pid, "seq": seq, "local_start": local, "n_tokens": n, "doc_ids": ids, "starts": starts, "payload": pack_codes(tokens)}], PAYLOAD)

        for batch in batches:
            for doc_id, got in zip(batch["doc_id"].to_pylist(), encoded(batch["text"], vocabulary), strict=True):
                ids.append(doc_id)
                starts.append(local + n)
                parts.append(got + end)
                n += len(got) // 4 + 1
                if n >= segment:
                    yield row()
                    seq, local, ids, starts, parts, n = seq + 1, local + n, [], [], [], 0
        if ids:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(segments, SCHEMA).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``base``, the number of tokens in all earlier range partitions."""
    found = spark.read.schema(SCHEMA).parquet(path)
    totals = found.groupBy("pid").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("pid", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))  # one row a range partition
    return found.join(F.broadcast(bases), "pid")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the codes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                tokens, starts = Codes(s["payload"]).all().astype("<u4"), np.array(s["starts"])
                ends = np.append(starts[1:], s["local_start"] + s["n_tokens"])
                crcs = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts - s["local_start"], ends - s["local_start"], strict=True)]
                columns = [pa.array(s["doc_ids"], pa.int64()), pa.array(s["base"] + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_segments(spark, path).mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """place, token for each of the global ``places`` (a list given by the caller), each read by random access."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                codes, start = Codes(s["payload"]), s["base"] + s["local_start"]
                yield pa.RecordBatch.from_pydict({"place": s["places"], "token": pa.array([codes.at(p - start) for p in s["places"]], pa.int64())})

    asked = F.lit(places).cast("array<bigint>") if places else F.array().cast("array<bigint>")
    start = F.col("base") + F.col("local_start")
    inside = F.filter(asked, lambda p: (p >= start) & (p < start + F.col("n_tokens")))
    hit = read_segments(spark, path).withColumn("places", inside).where("size(places) > 0")
    return hit.select("base", "local_start", "places", "payload").mapInArrow(rows, "place bigint, token bigint")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, vocabulary_path())
    return read_documents(spark, path)
