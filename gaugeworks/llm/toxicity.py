"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of an embedding of the word and the mean of embeddings of its character trigrams (both
hashed), so unseen words with known parts are understood. A text is scored in overlapping windows of WINDOW words,
STRIDE apart, over its whole length; two gated recurrent layers read each window in both directions, attention pools
their states, and the highest window decides.

Only texts are inputs. Labels are learned from a bounded sample: SAMPLE labelled documents of each class at most, none
over LONGEST bytes, of those whose crc32(doc_id) mod FOLDS is not 0. Windows have no labels of their own, so training picks, in each round, the
window that now scores highest in every document.

Defined cases: a null text counts as empty; a text without words is one empty window and gets the score of the bias;
a null doc_id is not held out; repeated rows score alike; without labels of both classes every score is 0; an empty
table gives no rows; other columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, hold, small_batches

WORDS, GRAMS, WIDTH, HIDDEN = 1 << 13, 1 << 13, 16, 8
WINDOW, STRIDE = 32, 16
#: Labelled documents of each class that a fit takes at most, and their longest text in bytes.
SAMPLE, LONGEST = 1000, 50_000
FOLDS, ROUNDS, SEED = 5, 14, 7
#: Words whose inputs (and trigrams whose places) a worker keeps, and windows read at once: so few that their products stay in one thread.
KEPT, AT_ONCE = 100_000, 512
#: A word; longer runs, as in scripts without spaces, are several words.
WORD = re.compile(r"\w{1,40}")

_readers: dict[int, Reader] = {}


class Places(dict):
    """Hashed place of a trigram, kept for at most KEPT trigrams."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[gram] = zlib.crc32(gram.encode("utf-8", "surrogatepass"), 1) % GRAMS
        return self[gram]


_places = Places()


def forget() -> None:
    _readers.clear()
    _places.clear()


def features(word: str) -> tuple[int, list[int]]:
    """Hashed places of a word and of its character trigrams, ends marked."""
    own, grams, _ = all_features([word])
    return int(own[0]), grams.tolist()


def all_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed places of words, those of their trigrams in one row, and how many each word has; each distinct trigram is hashed once."""
    data = "^" + "$^".join(words) + "$"
    many = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begin = np.cumsum(many + 2) - (many + 2)
    at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())  # where trigrams within one word begin
    _, firsts, back = np.unique(points[at] << 42 | points[at + 1] << 21 | points[at + 2], return_index=True, return_inverse=True)
    grams = np.array([_places[data[i : i + 3]] for i in at[firsts].tolist()])[back]
    return np.array([zlib.crc32(f"^{w}$".encode("utf-8", "surrogatepass")) % WORDS for w in words]), grams, many


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters: E (words), C (trigrams), W/U/b of both directions (update, reset, candidate), A/v attention, u/c output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"E": draw(WORDS, WIDTH, scale=0.1), "C": draw(GRAMS, WIDTH, scale=0.1)}
        for d in "fb":
            self.p |= {f"W{d}": draw(WIDTH, 3 * HIDDEN, scale=0.3), f"U{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, HIDDEN, scale=0.3), "v": draw(HIDDEN, scale=0.3), "u": draw(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}

    def run(self, x: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logit of each window; x: for each direction W·input + b at (window, step), mask: 1 where there is a word.

        Both directions go in one loop, the second from the end, and windows are the last axis of all arrays, so that
        every operation runs over long contiguous rows.
        """
        p, (n, steps) = self.p, mask.shape
        a = np.empty((steps, 2, 3 * HIDDEN, n), x["f"].dtype)
        a[:, 0], a[:, 1] = x["f"].transpose(1, 2, 0), x["b"][:, ::-1].transpose(1, 2, 0)
        a[:, :, : 2 * HIDDEN] *= 0.5  # a gate is the logistic function by the hyperbolic tangent, which needs no clipping
        m = np.ascontiguousarray(mask.T, a.dtype)
        both = np.stack([m, m[::-1]], axis=1)[:, :, None]
        gates, candidate = self.recurrent()
        half = gates * a.dtype.type(0.5)
        h, states, memory = np.zeros((2, HIDDEN, n), a.dtype), np.empty((steps, 2 * HIDDEN, n), a.dtype), []
        for t in range(steps):
            s = half @ h
            s += a[t, :, : 2 * HIDDEN]
            np.tanh(s, out=s)
            s *= 0.5
            s += 0.5
            z, r = s[:, :HIDDEN], s[:, HIDDEN:]
            g = candidate @ (r * h)
            g += a[t, :, 2 * HIDDEN :]
            np.tanh(g, out=g)
            if keep:
                memory.append((h, z, r, g))
            moved = g - h
            moved *= z
            moved *= both[t]
            h = h + moved
            states[t, :HIDDEN], states[steps - 1 - t, HIDDEN:] = h
        k = np.tanh(p["A"].T @ states)
        e = np.where(m > 0, p["v"] @ k, -1e9)
        w = np.exp(e - e.max(axis=0)) * m
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = (states * w[:, None]).sum(axis=0)
        logit = p["u"] @ pooled + p["c"][0]
        return (logit, states, k, w, pooled, both, memory) if keep else logit

    def recurrent(self) -> tuple[np.ndarray, np.ndarray]:
        """Recurrent weights of both directions, transposed: those of the two gates and those of the candidate."""
        U = np.stack([self.p["Uf"].T, self.p["Ub"].T])
        return np.ascontiguousarray(U[:, : 2 * HIDDEN]), np.ascontiguousarray(U[:, 2 * HIDDEN :])

    def gradients(self, inputs: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Gradients of the mean logistic loss; the one of the inputs (window, step, width) is under "x"."""
        p, (n, steps) = self.p, mask.shape
        x = {d: inputs @ p[f"W{d}"] + p[f"b{d}"] for d in "fb"}
        logit, states, k, w, pooled, both, memory = self.run(x, mask, keep=True)
        gates, candidate = self.recurrent()
        g: dict[str, np.ndarray] = {}
        dlogit = (sigmoid(logit) - y) / n
        g["u"], g["c"] = pooled @ dlogit, np.array([dlogit.sum()])
        dpooled = p["u"][:, None] * dlogit
        dw = (states * dpooled).sum(axis=1)
        de = w * (dw - (w * dw).sum(axis=0))
        dk = de[:, None] * p["v"][:, None] * (1 - k**2)
        g["v"] = (de[:, None] * k).sum(axis=(0, 2))
        g["A"] = (states @ dk.transpose(0, 2, 1)).sum(axis=0)
        dstates = w[:, None] * dpooled + p["A"] @ dk
        da, dU, dh = np.empty((steps, 2, 3 * HIDDEN, n), states.dtype), np.zeros((2, 3 * HIDDEN, HIDDEN), states.dtype), np.zeros((2, HIDDEN, n), states.dtype)
        for t in reversed(range(steps)):
            h, z, r, c = memory[t]
            dh[0] += dstates[t, :HIDDEN]
            dh[1] += dstates[steps - 1 - t, HIDDEN:]
            moved = dh * both[t]
            dc = moved * z * (1 - c * c)
            drh = candidate.transpose(0, 2, 1) @ dc
            da[t, :, :HIDDEN], da[t, :, HIDDEN : 2 * HIDDEN], da[t, :, 2 * HIDDEN :] = moved * (c - h) * z * (1 - z), drh * h * r * (1 - r), dc
            dgates = da[t, :, : 2 * HIDDEN]
            dU[:, : 2 * HIDDEN] += dgates @ h.transpose(0, 2, 1)
            dU[:, 2 * HIDDEN :] += dc @ (r * h).transpose(0, 2, 1)
            dh = dh - moved * z + drh * r + gates.transpose(0, 2, 1) @ dgates
        steps_first, dx = inputs.transpose(1, 2, 0), 0
        for i, d in enumerate("fb"):
            own = da[:, i][:: 1 - 2 * i]
            g[f"U{d}"], g[f"b{d}"] = dU[i].T, own.sum(axis=(0, 2))
            g[f"W{d}"] = (steps_first @ own.transpose(0, 2, 1)).sum(axis=0)
            dx = dx + p[f"W{d}"] @ own
        g["x"] = dx.transpose(2, 0, 1)
        return g, logit


def windows(n: int, stride: int = STRIDE) -> list[int]:
    """Starts of the windows over ``n`` words."""
    return list(range(0, max(1, n - WINDOW + stride), stride)) if n > WINDOW else [0]


def place(rows: list[np.ndarray], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of texts as (window, step), -1 where a window has no word, and the text each window is of."""
    parts, owners = [], []
    for i, words in enumerate(rows):
        starts = np.array(windows(len(words), stride))
        at = starts[:, None] + np.arange(WINDOW)
        parts.append(np.where(at < len(words), np.append(words, -1)[np.minimum(at, len(words))], -1))
        owners.append(np.full(len(starts), i))
    return np.concatenate(parts), np.concatenate(owners)


class Reader:
    """Scores texts with a trained network, keeping the layer inputs of the words it has met."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.network = Network()
        self.network.p = params
        self.rows: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.rows.clear()
        self.known = np.zeros((1024, 6 * HIDDEN), np.float32)

    def learn(self, words: list[str]) -> None:
        p = self.network.p
        own, places, counts = all_features(words)
        grams = np.add.reduceat(p["C"][places], np.cumsum(counts) - counts)
        x = p["E"][own] + grams / counts[:, None]
        first, last = len(self.rows), len(self.rows) + len(words)
        while last > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        self.known[first:last] = np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], axis=1)
        self.rows.update(zip(words, range(first, last), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window's probability of every text."""
        split = [WORD.findall(t.lower()) for t in texts]
        new = set().union(*split).difference(self.rows)
        if len(self.rows) + len(new) > KEPT:
            self.clear()
            new = set().union(*split)
        if new:
            self.learn(sorted(new))
        at, owners = place([np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)) for words in split])
        logits = np.empty(len(at), np.float32)
        for i in range(0, len(at), AT_ONCE):
            part = at[i : i + AT_ONCE]
            x = self.known[part]
            logits[i : i + AT_ONCE] = self.network.run({"f": x[:, :, : 3 * HIDDEN], "b": x[:, :, 3 * HIDDEN :]}, (part >= 0).astype(np.float32))
        best = np.full(len(texts), -np.inf, np.float32)
        np.maximum.at(best, owners, logits)
        return sigmoid(best.astype(np.float64))


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam over the window that scores highest in each document, after a first round over all windows.

    The windows are those that scoring uses and overlap by half.
    """
    rng, network = np.random.default_rng(seed), Network(seed)
    p, vocabulary = network.p, {}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(t.lower())], dtype=np.int64) for t in texts]
    order = list(vocabulary) or ["0"]
    vocabulary.clear()
    word_at, gram_at, many = map(np.concatenate, zip(*[all_features(order[i : i + 10_000]) for i in range(0, len(order), 10_000)], strict=True))
    del order
    gram_start, shares = np.cumsum(many) - many, (1 / many).astype(np.float32)[:, None]

    def grams_at(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams of the words in one row, and where each word's begin."""
        n = many[words]
        begin = np.cumsum(n) - n
        return gram_at[np.repeat(gram_start[words] - begin, n) + np.arange(n.sum())], begin

    def inputs(words: np.ndarray) -> np.ndarray:
        grams, begin = grams_at(words)
        return p["E"][word_at[words]] + np.add.reduceat(p["C"][grams], begin) * shares[words]

    at, owners = place(rows)
    y_all = np.array(labels, dtype=np.float32)[owners]
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        if turn == 0:
            chosen = rng.permutation(len(at))
        else:
            logits = []
            for i in range(0, len(at), AT_ONCE):
                own, back = np.unique(at[i : i + AT_ONCE], return_inverse=True)
                vectors = inputs(own)
                layers = {d: (np.einsum("nx,xa->na", vectors, p[f"W{d}"]) + p[f"b{d}"])[back.reshape(-1, WINDOW)] for d in "fb"}
                logits.append(network.run(layers, (at[i : i + AT_ONCE] >= 0).astype(np.float32)))
            logits = np.concatenate(logits)
            order = np.lexsort((logits, owners))
            best = order[np.append(np.flatnonzero(np.diff(owners[order])), len(order) - 1)]
            others = rng.permutation(np.flatnonzero(y_all == 0))[: len(texts) // 2]  # and some clean windows
            chosen = rng.permutation(np.concatenate([best, others]))
        rate = 0.01 * (1 - turn / rounds) + 0.001
        for i in range(0, len(chosen), 128):
            part = chosen[i : i + 128]
            words, mask = at[part], (at[part] >= 0).astype(np.float32)
            own, back = np.unique(words, return_inverse=True)
            vectors = inputs(own)
            g, _ = network.gradients(vectors[back.reshape(words.shape)] * mask[:, :, None], mask, y_all[part])
            dx = np.zeros_like(vectors)
            np.add.at(dx, back.reshape(-1), (g.pop("x") * mask[:, :, None]).reshape(-1, WIDTH))
            g["E"], g["C"] = np.zeros_like(p["E"]), np.zeros_like(p["C"])
            np.add.at(g["E"], word_at[own], dx)
            np.add.at(g["C"], grams_at(own)[0], np.repeat(dx * shares[own], many[own], axis=0))
            step += 1
            for k, v in g.items():
                m, s = state[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return p


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``sample`` documents of each class outside the held-out fold, chosen by a hash.

    Of rows that share a doc_id the smallest text counts, and the document is toxic if any of its labels says so.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # 2 * sample rows at most
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(ids), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()  # 2 * sample * LONGEST bytes at most
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [r.text for r in rows], [int(r.toxic) for r in rows]


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    texts, classes = labelled_sample(docs, labels)
    return train(texts, classes) if len(set(classes)) == 2 else None


def scored(params: dict[str, np.ndarray] | None):
    """A column function from a text to its score."""
    key = 0 if params is None else zlib.crc32(b"".join(params[k].tobytes() for k in sorted(params)))

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hold(forget)
        if params is not None and key not in _readers:
            _readers.clear()
            _readers[key] = Reader(params)
        for batch in batches:
            blocks = [batch.slice(i, 200) for i in range(0, len(batch), 200)] if params is not None else []
            parts = [_readers[key].scores([t or "" for t in block.to_pylist()]) for block in blocks] or [np.zeros(len(batch))]
            yield pa.array(np.concatenate(parts))

    return of


def score(docs: DataFrame, params: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(params)(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, params: dict[str, np.ndarray] | None) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.where(scored(params)(F.col("text")) < 0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
