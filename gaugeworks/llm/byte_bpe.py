"""Byte-level BPE with a hierarchical-bitmap rank queue.

The bytes of a pre-token form a linked list. Each adjacent pair that has a rank is put in the bucket of that rank; a
three-level bitmap marks the buckets that hold something, so the lowest rank is three find-first-set steps away. The
leftmost pair of that bucket is merged, its new neighbours are queued, and entries whose pair has changed meanwhile are
skipped when they come up. A merge costs the same in a pre-token of ten bytes or of a million.

Defined cases: a null text counts as empty and has no ids; repeated rows are encoded alike; null doc_ids stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens of which a worker keeps the ids, and their greatest length.
KEPT, KEPT_LENGTH = 1_000_000, 64
#: White space as Unicode's property has it, which the ranks' library means by \s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_encoders: dict[tuple[str, str], ByteBpe] = {}


class RankQueue:
    """Positions in buckets by rank; ``pop`` gives the lowest rank's leftmost. Ranks below 64 ** 3."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, int]:
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.low[a] = word = word & (word - 1)
            if not word:
                self.mid[b] = word = self.mid[b] & (self.mid[b] - 1)
                if not word:
                    self.top &= self.top - 1
        return rank, position


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(self.ranks.values()) >= 64**3:
            raise ValueError("more ranks than the bitmap has levels for")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> ByteBpe:
        """The encoder of this Python worker, loaded once."""
        if (path, pattern) not in _encoders:
            _encoders[path, pattern] = cls(path, pattern)
        return _encoders[path, pattern]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n, rank_of, queue = len(piece), ranks.get, RankQueue()
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once merged into an earlier part
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            if (rank := rank_of(piece[i : i + 2])) is not None:
                queue.push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            middle = end[i]
            if not middle or middle == n:
                continue
            stop = end[middle]
            if rank_of(piece[i:stop]) != rank:
                continue  # stale: a part of the pair has grown
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := rank_of(piece[i : end[stop]])) is not None:
                    queue.push(rank, i)
            if (left := before[i]) >= 0 and (rank := rank_of(piece[left:stop])) is not None:
                queue.push(rank, left)
        found, i = [], 0
        while i < n:
            found.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(found)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, each match of the pattern by itself."""
        pieces, known = self.split(text), self.known
        for piece in set(pieces).difference(known):
            if len(known) >= KEPT:
                known.clear()
                return self._all(pieces)
            if len(piece) > KEPT_LENGTH:
                return self._all(pieces)
            known[piece] = self.merge(piece.encode())
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def _all(self, pieces: list[str]) -> list[int]:
        own: dict[str, tuple[int, ...]] = {}
        for piece in set(pieces):
            own[piece] = self.known.get(piece) or self.merge(piece.encode())
        return list(chain.from_iterable(map(own.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids of every row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(t or "") for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id bigint, ids array<int>")


def round_trips(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to, for every row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path, pattern)
        for batch in batches:
            found = []
            for text in batch["text"].to_pylist():
                ids = bpe.encode(text or "")
                decimals = " ".join(map(bpe.decimal.__getitem__, ids)).encode()
                found.append((len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            counts, encoded, decoded = zip(*found, strict=True) if found else ([], [], [])
            columns = [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir), public_tokenizers.path(RANKS))
