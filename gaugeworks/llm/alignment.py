"""Aligning the tokens of two tokenizers over the same bytes.

The byte ranges of a text's B tokens are a static index, sorted ends, that each A token stabs by bisection for the B
tokens it overlaps. Every overlap is a link; a gap between tokens that no token of either side spans ends a group.
Both vocabularies split text at spaces after a visible character, so a text is aligned word by word and a worker keeps
the words it has met; where a vocabulary doesn't, or a word's bytes don't come back, texts are aligned whole.

Links are counted for the corpus by pairs of ids. Documents are taken in blocks of about BATCH_BYTES: a block sends
each of its pairs once and gets the pair's count back once, so a frequent pair has one row a block and is never hot.

Defined cases: a null or empty text, and one whose tokens' bytes aren't its own, has no tokens and zeros; repeated rows
are aligned each and count each; null doc_ids stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain, compress, islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import Scratch, batches_of, documents, hold, stage

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Words of which a worker keeps the alignment, and their greatest length; beyond that the half met last is dropped.
KEPT, KEPT_LENGTH = 300_000, 48
#: Fixed value: the split of A's file, which puts a boundary before each space that follows a visible character.
A_SPLIT = b'{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true}'
#: A word that ends so is never continued over the space behind it.
VISIBLE = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)]))
STAGED = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, at array<int>, times array<int>, code bigint, n bigint"
COLUMNS = [c.split()[0] for c in STAGED.split(", ")]
EMPTY = (0, 0, "", b"")

_aligners: dict[tuple[str, str], Aligner] = {}


def forget() -> None:
    _aligners.clear()


def byte_of_character() -> dict[str, int]:
    """What each character of a byte-level vocabulary stands for: visible Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Intervals:
    """The byte ranges of tokens side by side, as their ends."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum(sizes)

    def overlapping(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last token that share a byte with each range from ``low`` to ``high``, by bisection."""
        return np.searchsorted(self.ends, low, "right"), np.searchsorted(self.ends, high, "left")


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = byte_of_character()
        self.a_bytes = {i: bytes(map(byte.get, t)) if set(t) <= set(byte) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array(list(map(len, self.b_bytes)))
        self.a_size[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        # a token's decimal id and what follows it: the next of its side, B's side, the next group, the next text
        self.written = [f"{i}{end}" for i in range(max(len(self.a_size), len(self.b_size))) for end in ",|;\n"]
        # words stand alone if A splits before their space and no piece of B runs over one
        self.by_word = self.a.normalizer is None and self.a.pre_tokenizer.__getstate__() == A_SPLIT and not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, tuple] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        """The tokenizers of this Python worker, loaded once."""
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = cls(a_path, b_path)
        return _aligners[a_path, b_path]

    def link(self, a: np.ndarray, b: np.ndarray, last_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups of every text as text, all links' pairs of ids (B's in the high half), and how many each A token has.

        The tokens of many texts are given in a row; ``last_b`` says where each text's B tokens end.
        """
        index, high = Intervals(self.b_size[b]), np.cumsum(self.a_size[a])
        first, last = index.overlapping(high - self.a_size[a], high)
        cut = index.ends[last] == high  # the gap after the token isn't spanned by a B token either
        n = last - first + 1
        stabbed = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        links = b[stabbed] << 32 | np.repeat(a, n)
        # each group is written as its A tokens and then its B tokens
        a_ends, b_ends = np.flatnonzero(cut) + 1, last[cut] + 1
        b_before = np.concatenate([[0], b_ends])[np.cumsum(cut) - cut]
        b_group = np.searchsorted(b_ends, np.arange(len(b)), "right")
        after_b = np.zeros(len(b), np.int64)
        after_b[b_ends - 1] = 2
        after_b[last_b - 1] = 3
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before] = 4 * a + cut
        order[np.arange(len(b)) + a_ends[b_group]] = 4 * b + after_b
        return "".join(map(self.written.__getitem__, order.tolist())).split("\n")[:-1], links, n

    def aligned(self, texts: list[str]) -> list[tuple | None]:
        """(A tokens, B tokens, groups, links) of each text behind a space, or None where bytes don't come back."""
        all_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        all_b = self.b.encode(texts, num_threads=1)
        same = [b"".join(map(self.a_bytes.__getitem__, a)) == f" {t}".encode() == b"".join(map(self.b_bytes.__getitem__, b)) for t, a, b in zip(texts, all_a, all_b, strict=True)]
        all_a, all_b = list(compress(all_a, same)), list(compress(all_b, same))
        if not all_a:
            return [None] * len(texts)
        n_a, n_b = list(map(len, all_a)), list(map(len, all_b))
        groups, links, n = self.link(np.array(list(chain.from_iterable(all_a))), np.array(list(chain.from_iterable(all_b))), np.cumsum(n_b))
        ends, data = (8 * np.cumsum(n)[np.cumsum(n_a) - 1]).tolist(), links.tobytes()
        found = zip(n_a, n_b, groups, [data[i:j] for i, j in pairwise([0, *ends])], strict=True)
        return [next(found) if s else None for s in same]

    def words(self, text: str) -> list[str]:
        """The parts of a text that stand alone, each without the space before it."""
        if not self.by_word:
            return [text]
        found, held = [], None
        for part in text.split(" "):
            held = part if held is None else f"{held} {part}"
            if held and held[-1] in VISIBLE:
                found.append(held)
                held = None
        if held is not None:  # spaces at the end, or a last character of another kind
            if held.strip(" ") or not found:
                found.append(held)
            else:
                found[-1] += f" {held}"
        return found

    def documents(self, texts: list[str]) -> list[tuple]:
        """``aligned`` of every text, EMPTY where there are no tokens."""
        known, parts, new = self.known, [], {}
        for text in texts:
            words = text.split(" ")
            if not all(map(known.__contains__, words)):
                words = self.words(text)
                new.update((w, None) for w in words if w not in known)
            parts.append(words)
        for at in range(0, len(new), 10_000):
            some = list(islice(new, at, at + 10_000))
            new.update(zip(some, self.aligned(some), strict=True))
        found = []
        for text, words in zip(texts, parts, strict=True):
            own = [known.get(w) or new.get(w) for w in words] if text else []
            if None in own:
                found.append((self.aligned([text])[0] if len(own) > 1 else None) or EMPTY)
                continue
            a, b, groups, links = zip(*own, strict=True) if own else ((), (), (), ())
            found.append((sum(a), sum(b), ";".join(groups), b"".join(links)))
        if len(known) + len(new) > KEPT:  # those met first are mostly the frequent ones
            self.known = known = dict(islice(known.items(), KEPT // 2))
        fit = ((w, x) for w, x in new.items() if x and 0 < len(w) <= KEPT_LENGTH and w[-1] in VISIBLE)
        known.update(islice(fit, KEPT - len(known)))
        return found


def linked(docs: DataFrame, a_path: str, b_path: str, digest: bool) -> DataFrame:
    """Rows of STAGED: one for each document, then one for each pair of ids of its block (``code`` isn't null there).

    ``groups`` is the text of the groups or, with ``digest``, its SHA-256 if there are tokens. ``at`` says which of the
    block's pairs, in ascending order of ``code``, a document has, and ``times`` how often.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(forget)
        aligner = Aligner.of(a_path, b_path)
        types = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]

        def batch_of(length: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(length, t) for c, t in zip(COLUMNS, types, strict=True)], COLUMNS)

        for number, batch in enumerate(batches):
            n_a, n_b, groups, links = [], [], [], []
            for at in range(0, batch.num_rows, 200):
                for a, b, text, link in aligner.documents([t or "" for t in batch["text"].slice(at, 200).to_pylist()]):
                    n_a.append(a)
                    n_b.append(b)
                    groups.append((text.count("|"), hashlib.sha256(text.encode()).hexdigest() if digest and text else text))
                    links.append(np.frombuffer(link, np.int64))
            counts = list(map(len, links))
            codes, inverse, times = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True, return_counts=True)
            bounds = np.cumsum([0, *counts])
            own = [np.unique(inverse[i:j].astype(np.int32), return_counts=True) for i, j in zip(bounds, bounds[1:], strict=False)]
            block = [TaskContext.get().partitionId() << 32 | number]
            yield batch_of(
                batch.num_rows, block=block * batch.num_rows, doc_id=batch["doc_id"], n_a=n_a, n_b=n_b, n_groups=[g for g, _ in groups], n_links=counts,
                groups=[g for _, g in groups], at=[o[0] for o in own], times=[o[1].astype(np.int32) for o in own],
            )
            for at in range(0, len(codes), 10_000):
                some = slice(at, at + 10_000)
                yield batch_of(len(codes[some]), block=block * len(codes[some]), code=codes[some], n=times[some])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, STAGED)


def pair_counts(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """code, links (how many of the corpus) and best (no other A id has more with its B id) of each pair of ids."""
    counts = scratch.table(pairs.groupBy("code").agg(F.sum("n").alias("links")), "counts")
    b = F.shiftright("code", 32)
    most = F.broadcast(counts.groupBy(b.alias("b")).agg(F.max("links").alias("most")))  # at most one row an id of B's vocabulary
    return counts.join(most, b == F.col("b")).select("code", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "alignment")
    with batches_of(docs.sparkSession):
        staged = scratch.table(linked(docs, a_path, b_path, digest), "linked")
    pairs = staged.where(F.col("code").isNotNull()).select("block", "code", "n")
    values = pairs.select(F.col("block").alias("of"), "code").join(pair_counts(pairs, scratch).hint("merge"), "code")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("code")
        counts, best = right["links"].to_numpy(), right["best"].to_numpy()
        found = []
        for at, times in zip(left["at"], left["times"], strict=True):
            at, times = at.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            found.append((int(times[best[at]].sum()), int((times * counts[at]).sum())) if len(at) else (0, 0))
        left = left.drop_columns(["at", "times", "block"])
        return left.append_column("n_best", pa.array([f[0] for f in found], pa.int64())).append_column("count_sum", pa.array([f[1] for f in found], pa.int64()))

    texts = staged.where(F.col("code").isNull()).drop("code", "n")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint"
    found = stage(texts.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(sums, schema), "aligned")
    scratch.clear()
    return found


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(documents(spark, sf_dir), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
