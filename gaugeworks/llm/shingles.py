"""Sets of word shingles: their hashes, and what can be told of two sets' similarity from less than the whole sets."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import text_of

SEED = 42
#: Words whose hashes a worker keeps, and texts that it takes at once.
KEPT, AT_ONCE = 100_000, 200
#: The shortest parity sketch in bits; longer sets have longer ones.
PARITY = 512
#: About as many texts are read for shingles that many texts share, and so many of those are put last; no result depends on them.
ORDERED_BY, COMMON = 4_000, 20_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_words = _WordHashes()


def forget() -> None:
    _words.clear()


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct word shingles, A-Z lower-cased; one of all words if they are fewer.

    A shingle's hash mixes the XXH64 values of its words in their order.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    found = np.full(len(words) - width + 1, width + 1, np.uint64)
    for i in range(width):
        found = (found ^ hashes[i : i + len(found)]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(32)
    return np.unique(found.view(np.int64))


def parity(items: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of ``items`` is i modulo the bits, a power of two not under PARITY or the items."""
    bits = max(PARITY, 1 << (len(items) - 1).bit_length())
    odd = np.bincount(items & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def may_be_similar(a: Column, b: Column, n_a: Column, n_b: Column, least: float) -> Column:
    """Whether the parity sketches ``a`` and ``b`` of sets of ``n_a`` and ``n_b`` items leave a similarity of ``least`` possible.

    No pair of that similarity is refused: of such sets the smaller has at least ``least`` of the larger's size, and
    at most (n_a + n_b) (1 - least) / (1 + least) items are in one only. Each of these changes one bit of the sketches,
    also when the longer sketch is folded to the shorter by exclusive or.
    """
    length = F.least(F.size(a), F.size(b))

    def folded(x: Column, i: Column) -> Column:
        return F.when(F.size(x) > length, F.get(x, i).bitwiseXOR(F.get(x, i + length))).otherwise(F.get(x, i))

    apart = F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), lambda n, i: n + F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))
    near_sizes = F.least(n_a, n_b) >= F.greatest(n_a, n_b) * F.lit(least) - F.lit(1e-6)
    return F.when(near_sizes, apart <= (n_a + n_b) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)).otherwise(F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two whole shingle sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def head(items: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first items, ``common`` ones last, of which two sets of similarity ``least`` share one whatever else they have.

    Such sets share ``least`` of the items of each, so the first shared one has fewer than the others before it.
    """
    often = np.zeros(len(items), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, items), len(common) - 1)
        often = np.where(common[at] == items, counts[at], 0)
    return items[np.lexsort((items, often))[: len(items) - math.ceil(least * len(items) - 1e-9) + 1]]


def common_shingles(docs: DataFrame, sets, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of shingles that many texts share, from a sample of texts chosen by a hash."""
    chosen = docs.select(text_of().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // ORDERED_BY))) == 0)
    counted = chosen.select(F.explode(sets("text")).alias("item")).groupBy("item").agg(F.count("*").alias("n")).where("n > 2")
    rows = sorted(tuple(r) for r in counted.orderBy(F.desc("n"), "item").limit(COMMON).collect())  # COMMON rows of two numbers
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
