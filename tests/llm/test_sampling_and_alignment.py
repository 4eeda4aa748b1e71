"""Resampling, mixing and token alignment against brute force, on awkward tables and through the registered queries."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import accumulate, pairwise

import pytest
import sentencepiece
from gaugeworks.llm import alignment, mixing, resampling
from gaugeworks.llm.common import Scratch, batches_of
from gaugeworks.llm.queries import QUERIES
from public_tokenizers import path
from test_text_operators import SCHEMA, awkward_rows, keyed
from tokenizers import Tokenizer

#: Further texts: runs of spaces, controls, B's own space sign, byte pieces as text, and a word over a slice of bytes.
MORE = ["  two  spaces ", " ", "a\n  b\t c \n", "▁x", "<0x41> <s> </s> <|endoftext|>", " a 　b\x1c c", "\x00 nul", "日本 語 \U0001f600\U0001f600", "x" * 50 + " y", "Fin. été é "]
SOURCES = ["b", "a", None, "", "日", "z"]
ROWS = [*awkward_rows(), *[(200 + i, t, "en", "d", 1, 2, 3, 4) for i, t in enumerate(MORE)]]
ROWS = [(*r, SOURCES[min(i % 11, 5)]) for i, r in enumerate(ROWS)]
FULL = SCHEMA + ", source string, place int, key string, size string, code string, `row` string"
AIMS = [(1, "foo bar it s the naive", "x"), (2, None, "y"), (3, "Ämt FOO foo12 İ", "z"), (None, "", None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("sampling")
    spark.createDataFrame([(*r, 1, "k", "s", "c", "r") for r in ROWS], FULL).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(AIMS, "item_id bigint, text string, extra string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def runs(text, longest=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resampling(rows, aims, longest=1, least=20, percent=10, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    every = [list(map(bucket, runs(r[1], longest)[1])) for r in rows]
    s, t = Counter(b for x in every for b in x), Counter(bucket(f) for a in aims for f in runs(a[1], longest)[1])
    whole_s, whole_t = sum(s.values()), sum(t.values())
    found = []
    for r, own in zip(rows, every, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets)))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([r[0], len(own), weight, score, None, len(runs(r[1])[0])])
    able = sorted((f for f in found if f[5] >= least), key=lambda f: (-f[3], f[0] is not None, f[0] or 0, f[1]))
    for rank, f in enumerate(able[: percent * len(able) // 100], 1):
        f[4] = rank
    return [f[:5] for f in found]


def test_op11(spark, folder):
    found = QUERIES["op11_resampling"](spark, folder)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert keyed(found.collect()) == keyed(brute_resampling(ROWS, AIMS)) and found.where("rank is not null").count() == 2


def test_resampling_of_longer_runs_over_slices_and_blocks(spark, monkeypatch):
    docs, aims = spark.createDataFrame([r[:2] for r in ROWS], "doc_id bigint, text string"), spark.createDataFrame(AIMS, "id bigint, text string, extra string")
    monkeypatch.setattr(resampling, "SLICE", 50)
    for text in (r[1] for r in ROWS):
        total, at, counts = resampling.cells(text, 3, 500)
        want = Counter(zlib.crc32(f.encode()) % 500 for f in runs(text, 3)[1])
        assert total == len(runs(text)[0]) and dict(zip(at.tolist(), counts.tolist(), strict=True)) == dict(want)
    found = resampling.resample(docs, aims, "id", percent=50, least=3, longest=2, buckets=64).select("doc_id", "n_features", "weight", "score", "rank")
    assert keyed(found.collect()) == keyed(brute_resampling(ROWS, AIMS, 2, 3, 50, 64))


def test_resampling_ends_where_nothing_is_left_or_aimed_at(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resample(none, docs, "doc_id").collect() == []
    assert keyed(resampling.resample(docs, none, "doc_id", percent=100, least=2).select("doc_id", "n_features", "weight", "score", "rank").collect()) == keyed(brute_resampling([(1, "a b"), (1, "a b"), (2, None)], [], 1, 2, 100))


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, open_, left, found = {s: weights[i % len(weights)] for i, s in enumerate(names)}, set(names), share * sum(sizes.values()), {}
    while open_:
        parts = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if parts[s] > cap * sizes[s]}
        if not above:
            return found | parts
        found |= {s: cap * sizes[s] for s in above}
        left -= sum(found[s] for s in above)
        open_ -= above
    return found


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(found, rows):
    """Sizes, sources and targets by brute force; what is taken within a document of its target."""
    sizes, longest = Counter(), Counter()
    for r in rows:
        sizes[r[-1]] += words(r[1])
        longest[r[-1]] = max(longest[r[-1]], words(r[1]))
    targets = brute_targets(sizes)
    assert keyed((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in found) == keyed((r[0], words(r[1]), sizes[r[-1]], round(targets[r[-1]], 6)) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in found)
    off, most = Counter(), Counter()  # sources that look alike are judged together
    for r in found:
        off[round(r.target, 6), r.source_size] += r.taken
    for s, target in targets.items():
        off[round(target, 6), sizes[s]] -= target
        most[round(target, 6), sizes[s]] += longest[s]
    assert all(abs(x) <= most[s] for s, x in off.items())


def test_op12(spark, folder):
    found = QUERIES["op12_mixing"](spark, folder)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    first = found.collect()
    check_mix(first, ROWS)
    assert keyed(first) == keyed(QUERIES["op12_mixing"](spark, folder).repartition(2).collect())


def test_mixing_of_a_hot_source_and_of_all_targets_at_their_caps(spark):
    rows = [(i, "w " * (1 + i * i % 37), "big" if i % 3 else f"s{i % 60:02}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    scratch = Scratch(spark, "mixing")
    found = mixing.copies(docs, scratch).selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken").collect()
    check_mix(found, rows)
    full = mixing.copies(docs, scratch, share=4.0, cap=1.0).collect()
    assert {r.copies for r in full} == {1} and all(r.target == r.source_size for r in full)


def test_mix_emits_whole_rows_once_a_copy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    taken = {}
    for r in QUERIES["op12_mixing"](spark, folder).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    found = mixing.mix(docs.withColumn("copy", docs.n))
    assert found.columns == [*docs.columns, "copy", "copy_"]
    rows = found.collect()
    emitted = Counter()
    for r in rows:
        emitted[r.doc_id] += words(r.text)
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in emitted.items() if v} and {r.copy_ for r in rows} == {1, 2}
    assert mixing.mix(docs.limit(0)).collect() == []


def brute_alignment(rows):
    a, b = Tokenizer.from_file(path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte = {c: i for i, c in ((i, chr(i)) for i in [*range(33, 127), *range(161, 173), *range(174, 256)])}
    byte |= {chr(256 + n): i for n, i in enumerate(x for x in range(256) if x not in set(byte.values()))}
    aligned, count = [], Counter()
    for r in rows:
        ids = a.encode(" " + (r[1] or ""), add_special_tokens=False).ids, b.encode(r[1] or "")
        data = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], map(b.id_to_piece, ids[1]), strict=True)]
        if not r[1] or any(b"".join(d) != f" {r[1]}".encode() for d in data):
            aligned.append(([], [], [], []))
            continue
        spans = [list(pairwise([0, *accumulate(map(len, d))])) for d in data]
        links, at = [], 0
        for i, (low, high) in zip(ids[0], spans[0], strict=True):
            while spans[1][at][1] <= low:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][0] < high:
                links.append((i, ids[1][k]))
                k += 1
        cuts = sorted({h for _, h in spans[0]} & {h for _, h in spans[1]})
        groups = ["|".join(",".join(str(i) for i, (_, h) in zip(ids[side], spans[side], strict=True) if low < h <= high) for side in (0, 1)) for low, high in pairwise([0, *cuts])]
        aligned.append((*ids, groups, links))
        count.update(links)
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(r[0], len(x), len(y), len(g), len(p), sum(count[q] == best[q[1]] for q in p), sum(count[q] for q in p), digest(g)) for r, (x, y, g, p) in zip(rows, aligned, strict=True)]


def test_op13(spark, folder):
    found = QUERIES["op13_alignment"](spark, folder)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows, want = found.collect(), brute_alignment(ROWS)
    assert keyed(rows) == keyed(want) and sum(r[1] == 0 for r in want) == 4


def test_alignment_in_small_blocks_gives_the_groups_themselves(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    paths = path(alignment.A_FILE), path(alignment.B_FILE)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "4")
    try:
        found = alignment.align(docs, *paths).collect()
    finally:
        spark.conf.unset(name)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert keyed((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, digest(r.groups)) for r in found) == keyed(brute_alignment(ROWS))
    assert alignment.align(docs.limit(0), *paths).collect() == []


def test_aligned_words_equal_whole_texts():
    aligner = alignment.Aligner(path(alignment.A_FILE), path(alignment.B_FILE))
    assert aligner.by_word
    texts = [r[1] for r in ROWS if r[1]] * 2
    by_word = aligner.documents(texts)
    aligner.by_word, aligner.known = False, {}
    assert by_word == aligner.documents(texts)


def test_batch_size_is_put_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with batches_of(spark, 1000):
        assert spark.conf.get(name) == "1000"
    assert spark.conf.get(name) == before
