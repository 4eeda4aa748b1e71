"""Packing documents into sequences by swap-based local search.

Only documents longer than a sequence are cut. The pieces (no ids, a few numbers each) are dealt evenly over groups of
about GROUP pieces; each group is packed by itself, and the emptiest sequences of all groups are packed again together.

Inside a group, pieces in the order they come give a poor start. The local search then takes the emptiest sequences
and moves a piece, exchanges one for one, or two for one with fuller ones, always raising the sum of squared fills,
until they are empty, nothing improves, or the number of sequences is the least possible. Where it sticks above that, it
starts again from the longest pieces, and last exchanges any number of pieces among a few underfull sequences.

Defined cases: a null text counts as empty and is one piece of the end id; repeated rows are packed each; null
doc_ids stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, documents, small_batches, stage
from gaugeworks.llm.word_tokens import encoded, vocabulary_path

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together, and one in how many sequences of a group is packed again with those of others.
GROUP, LOOSE = 100_000, 50
#: Tries at exchanges of any number of pieces once those of one and two end; it bounds time and leaves no piece out.
EFFORT = 20_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, ids in enumerate(encoded(batch["text"], vocabulary)):
                ids += end
                for k in range(-(-len(ids) // (4 * capacity))):
                    part = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                    found.append((row, k, capacity * k, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = np.array(found, dtype=np.int64).reshape(-1, 5).T
            columns = [batch["doc_id"].take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Bins:
    """Sequences of pieces, findable by the room they have and by the lengths of pieces in sequences of a room."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[set[int]] = []
        self.room: list[int] = []
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: some sequence has room r
        self.held = [0] * (capacity + 1)  # bit n of held[r]: some sequence of room r has a piece of length n
        self.holders: dict[tuple[int, int], set[int]] = {}  # (room, length): those sequences

    def _file(self, b: int, room: int) -> None:
        self.room[b] = room
        self.by_room[room].add(b)
        self.rooms |= 1 << room
        for n in {self.lengths[i] for i in self.items[b]} if room else ():
            self.held[room] |= 1 << n
            self.holders.setdefault((room, n), set()).add(b)

    def _unfile(self, b: int) -> None:
        room = self.room[b]
        self.by_room[room].discard(b)
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        for n in {self.lengths[i] for i in self.items[b]} if room else ():
            self.holders[room, n].discard(b)
            if not self.holders[room, n]:
                self.held[room] &= ~(1 << n)

    def change(self, b: int, out: list[int] = (), into: list[int] = ()) -> None:
        """Take pieces out of a sequence and put others into it."""
        self._unfile(b)
        self.items[b].difference_update(out)
        self.items[b].update(into)
        self._file(b, self.room[b] + sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in into))

    def open(self) -> int:
        self.items.append(set())
        self.room.append(self.capacity)
        self._file(len(self.room) - 1, self.capacity)
        return len(self.room) - 1

    def used(self) -> int:
        return sum(1 for x in self.items if x)

    def underfull(self) -> list[int]:
        """Sequences with pieces and room, the emptiest first."""
        return sorted((b for b, x in enumerate(self.items) if x and self.room[b]), key=lambda b: (-self.room[b], b))

    def tightest(self, length: int, most: int, besides: int = -1) -> int:
        """The sequence with the least room for ``length``, and no more than ``most``, or -1."""
        fitting = self.rooms >> length
        while fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            if room > most:
                break
            found = next((b for b in self.by_room[room] if b != besides and self.items[b]), -1)
            if found >= 0:
                return found
            fitting &= fitting - 1
        return -1

    def fit(self, item: int) -> None:
        b = self.tightest(self.lengths[item], self.capacity)
        self.change(self.open() if b < 0 else b, into=[item])

    def partner(self, b: int, length: int) -> tuple[int, int, int]:
        """(gain, sequence, length) of the piece that a fuller sequence best gives for ``length`` from ``b``; gain 0: none.

        The gain is what ``b`` loses, at most the room there. All sequences are covered: rooms are gone through from
        the largest, and each room's lengths are one number of bits.
        """
        best = (0, -1, 0)
        rooms = self.rooms & ((1 << (self.room[b] + 1)) - 1)
        while rooms:
            room = rooms.bit_length() - 1
            if min(room, length - 1) <= best[0]:
                break
            rooms ^= 1 << room
            low = max(1, length - room)
            while low < length:
                fitting = self.held[room] >> low
                back = low + (fitting & -fitting).bit_length() - 1 if fitting else length
                if length - back <= best[0]:
                    break
                to = next((x for x in self.holders[room, back] if x != b), -1)
                if to >= 0:
                    best = (length - back, to, back)
                    break
                low = back + 1
        return best


def improve(bins: Bins, least: int) -> int:
    """Empty sequences, the emptiest first, by moves, one-for-one and two-for-one exchanges with fuller ones.

    Every step raises the sum of squared fills, so the search ends: when a pass over all underfull sequences changes
    nothing, or the number of sequences is ``least``. Gives the number of sequences that it emptied.
    """
    lengths = bins.lengths
    used, emptied, changed = bins.used(), 0, True
    while changed and used - emptied > least:
        changed = False
        for b in bins.underfull():
            while bins.items[b] and (move(bins, b, lengths) or exchange(bins, b, lengths)):
                changed = True
            emptied += not bins.items[b]
            if used - emptied <= least:
                break
    return emptied


def move(bins: Bins, b: int, lengths: list[int]) -> bool:
    """Move what fits from ``b`` into fuller sequences, long pieces first."""
    moved = False
    for i in sorted(bins.items[b], key=lambda i: -lengths[i]):
        to = bins.tightest(lengths[i], bins.room[b], besides=b)
        if to >= 0:
            bins.change(b, out=[i])
            bins.change(to, into=[i])
            moved = True
    return moved


def exchange(bins: Bins, b: int, lengths: list[int]) -> bool:
    """The best exchange of one piece of ``b``, or else of two, for a shorter one of a fuller sequence.

    Pieces of one length are alike, so a sequence has some dozens of kinds at most, however many pieces.
    """
    alike: dict[int, list[int]] = {}
    for i in sorted(bins.items[b]):
        alike.setdefault(lengths[i], []).append(i)
    kinds = sorted(alike, reverse=True)
    one = {n: alike[n][:1] for n in kinds}
    two = {m + n: [alike[m][0], alike[n][-1]] for k, m in enumerate(kinds) for n in kinds[k:] if m != n or len(alike[n]) > 1}
    for give in (one, two):
        best = max(((*bins.partner(b, n), n) for n in give), default=(0,))
        if best[0] > 0:
            _, to, back, n = best
            other = next(i for i in bins.items[to] if lengths[i] == back)
            bins.change(b, out=give[n], into=[other])
            bins.change(to, out=[other], into=give[n])
            return True
    return False


def fullest(pieces: list[int], lengths: list[int], capacity: int) -> list[int]:
    """Pieces whose lengths come as near to ``capacity`` as those of any choice; bit n of a state: sum n can be had."""
    states = [1]
    for i in pieces:
        states.append(states[-1] | states[-1] << lengths[i])
        if states[-1] >> capacity & 1:
            break
    left = (states[-1] & ((1 << (capacity + 1)) - 1)).bit_length() - 1
    chosen = []
    for k in range(len(states) - 1, 0, -1):
        if not states[k - 1] >> left & 1:
            chosen.append(pieces[k - 1])
            left -= lengths[pieces[k - 1]]
    return chosen


def exchange_among(bins: Bins, some: list[int]) -> bool:
    """Exchange any pieces among a few sequences so that one after the other gets as full as it can.

    Done only if it raises the sum of squared fills, as every step of the search does.
    """
    lengths, capacity = bins.lengths, bins.capacity
    pool = sorted((i for b in some for i in bins.items[b]), key=lambda i: (-lengths[i], i))
    parts = []
    for _ in some[1:]:
        part = set(fullest(pool, lengths, capacity))
        parts.append(part)
        pool = [i for i in pool if i not in part]
    parts.append(set(pool))
    fills = [sum(lengths[i] for i in part) for part in parts]
    if fills[-1] > capacity or sum(f * f for f in fills) <= sum((capacity - bins.room[b]) ** 2 for b in some):
        return False
    for b, part in zip(some, parts, strict=True):
        old = bins.items[b]
        bins.change(b, out=list(old - part), into=list(part - old))
    return True


def regroup(bins: Bins, least: int, effort: int = EFFORT) -> None:
    """Exchanges of any number of pieces between two, then among three and four, underfull sequences.

    Half of ``effort`` tries go to pairs, from the emptiest on; threes and fours are drawn, with a bias to the emptiest.
    """
    rng = Random(len(bins.items))
    open_ = bins.underfull()
    for b, to in islice(combinations(open_, 2), effort // 2):
        if bins.items[b] and bins.items[to] and bins.room[b] and bins.room[to]:
            exchange_among(bins, [to, b])
    for n in range(effort // 2):
        if n % 500 == 0:
            open_ = bins.underfull()
            if len(open_) < 3 or bins.used() <= least:
                return
        some = sorted({int(len(open_) * rng.random() ** (1 + n % 3)) for _ in range(3 + n % 2)}, reverse=True)
        some = [open_[k] for k in some if bins.items[open_[k]]]
        if len(some) > 1:
            exchange_among(bins, some)


def searched(lengths: list[int], order: list[int], capacity: int, least: int) -> tuple[Bins, int]:
    """What the search makes of pieces put, in an order, into the tightest open sequence; and how many it emptied."""
    bins = Bins(lengths, capacity)
    for item in order:
        bins.fit(item)
    return bins, improve(bins, least)


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """The sequence of each piece, numbered from 0, the room of each sequence, and how many the search emptied.

    The start puts pieces in the order they come into the tightest open sequence, and the local search does the rest.
    If it ends above the least possible number it starts once more from the longest pieces, and the better end is
    worked on by exchanges of any number of pieces.
    """
    least = -(-sum(lengths) // capacity)
    bins, emptied = searched(lengths, list(range(len(lengths))), capacity, least)
    if bins.used() > least:
        # stuck where short pieces are shut in full sequences: search again from a start that has them last
        stuck, order = bins.used(), list(range(len(lengths)))
        del bins  # one search is held at a time
        bins, more = searched(lengths, sorted(order, key=lambda i: (-lengths[i], i)), capacity, least)
        if bins.used() < stuck:
            emptied = more
        else:
            bins, emptied = searched(lengths, order, capacity, least)
    if bins.used() > least:
        before = bins.used()
        regroup(bins, least)
        improve(bins, least)
        emptied += before - bins.used()
    found, rooms = [0] * len(lengths), []
    for items, room in zip(bins.items, bins.room, strict=True):
        for i in items:
            found[i] = len(rooms)
        if items:
            rooms.append(room)
    return found, rooms, emptied


def _packed(parts: DataFrame, capacity: int, groups: int, level: int) -> DataFrame:
    """Pieces with sequence_id, offset and ``loose``, each group packed by itself."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)  # about GROUP rows of numbers
        if not own:
            return
        table = pa.Table.from_batches(own)
        lengths = table["length"].to_pylist()
        numbers, rooms, _ = pack_lengths(lengths, capacity)
        offsets, filled = [], [0] * len(rooms)
        for number, length in zip(numbers, lengths, strict=True):
            offsets.append(filled[number])
            filled[number] += length
        emptiest = set(sorted(range(len(rooms)), key=lambda n: -rooms[n])[: -(-len(rooms) // LOOSE)]) if groups > 1 else set()
        ids = pc.add(pa.array(numbers, pa.int64()), (level << 56) + (TaskContext.get().partitionId() << 32))
        table = table.append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))
        yield from table.append_column("loose", pa.array([n in emptiest for n in numbers])).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id bigint, offset bigint, loose boolean"
    return parts.repartition(groups).mapInArrow(rows, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to every piece of a written table of pieces.

    Groups of about ``group`` pieces are packed apart. One in LOOSE sequences of each group, the emptiest, is opened
    again and its pieces are packed with those of the other groups, until a single group is left. So what groups lose
    by being apart is made good but for about a sequence a level, and there are few levels.
    """
    scratch, level, done = Scratch(parts.sparkSession, "packed"), 0, []
    columns, groups = [*parts.columns, "sequence_id", "offset"], 1 << 40
    while True:
        groups = max(1, min(-(-parts.count() // group), groups // 2))  # fewer at each level, however short the pieces
        found = scratch.table(_packed(parts, capacity, groups, level), "pieces") if groups > 1 else _packed(parts, capacity, 1, level)
        done.append(found.where("not loose").select(*columns))
        if groups == 1:
            return reduce(DataFrame.unionByName, done)
        parts, level = found.where("loose").select(*parts.columns), level + 1


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    return pack(stage(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity, group)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary_path())
