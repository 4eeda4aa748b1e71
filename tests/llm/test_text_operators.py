"""SimHash, exact dedup, sharding, tokens, BPE and packing against brute force on small, awkward tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from gaugeworks.llm import byte_bpe, exact_dedup, packing, sharding, shingles, simhash, token_file, word_tokens
from gaugeworks.llm.common import Scratch, join_spread, new_path
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, digest string, n int, label int, pid int, shard int"


def awkward_rows():
    rng = random.Random(5)
    words = ["the", "Ämt", "foo", "bar-baz", "it's", "x1²", "don't", "\u65e5\u672c", "İstanbul", "ſ", "naïve"]
    base = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(120))
    rows = [(i, base[: 40 * i]) for i in range(10)]
    rows += [(20 + i, base.replace("foo", "f\too", 1)) for i in range(3)] + [(30, base + " end"), (31, base.upper())]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "one"), (44, "<|endoftext|> a"), (45, "a\u00a0b\u0085c\x1cd e\u0301"), (46, "z" * 3000)]
    rows += [(None, "null id"), (None, base), (50, "again"), (50, "again"), (51, "again"), (52, "again ")]
    rows += [(60 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 900)))) for i in range(12)]
    return [(*row, "en", "d", 1, 2, 3, 4) for row in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for r, c in zip(rows, label, strict=True):
        low[c] = min((x for x in (low.get(c), r[0]) if x is not None), default=None)
    return [(r[0], f"{f:016x}", low[c]) for r, f, c in zip(rows, fps, label, strict=True)]


def test_simhash_against_brute_force(docs, none):
    found = simhash.near_duplicates(docs)
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found.collect()]
    assert keyed(got) == keyed(brute_components(awkward_rows()))
    assert simhash.near_duplicates(none).collect() == []


def test_links_are_all_pairs_within_distance(spark):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(6):
            values.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 130)] + [(7, 7), (200, 150)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100), 150: 150, 200: 150}


def test_near_copies_keep_one_of_each_group(spark):
    rng = random.Random(9)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(300)]
        for c in range(g):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(300)] = rng.choice(vocabulary)
            rows.append((100 * g + c, " ".join(copy), "x"))
    docs = spark.createDataFrame([*rows, (None, "lost", "x"), (5, None, "x")], "doc_id bigint, text string, key string")
    got = simhash.deduplicate(docs)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([None, 5, *(100 * g for g in range(1, 12))], key=repr)
    assert got.columns == docs.columns
    assert simhash.deduplicate(docs.limit(0)).collect() == []


def test_parity_sketches_refuse_no_similar_pair(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for n in (40, 150, 210, 420, 505, 530, 1030):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for i in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + n // 30)):
                copy[rng.randrange(n)] = "x" + str(rng.randrange(10**6))
            rows.append((1000 * n + i, " ".join(copy + base[: rng.randrange(n // 8)])))
    sets = {k: shingles.shingle_set(t, 5) for k, t in rows}
    odd = {k: shingles.parity(s).tolist() for k, s in sets.items()}
    assert {len(x) for x in odd.values()} == {8, 16, 32}
    pairs = [(len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8, odd[a], odd[b], len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b]
    F = simhash.F
    df = spark.createDataFrame(pairs, "near boolean, p array<bigint>, q array<bigint>, n int, m int")
    got = [tuple(r) for r in df.select("near", shingles.may_be_similar(*map(F.col, "pqnm"), 0.8)).collect()]
    assert (True, False) not in got and got.count((True, True)) > 20 and got.count((False, False)) > 1000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(simhash.similar_groups(docs).collect())
    monkeypatch.setattr(simhash, "CROWD", 1)
    assert sorted(simhash.similar_groups(docs).collect()) == want


def test_exact_dedup_and_its_index(spark, docs, none):
    rows = awkward_rows()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, t in zip(rows, texts, strict=True):
        groups.setdefault(t, []).append(r[0])
    want = []
    for r, t in zip(rows, texts, strict=True):
        keep = min((x for x in groups[t] if x is not None), default=None)
        want.append((hashlib.sha256(t.encode()).hexdigest(), r[0], keep, len(groups[t]), r[0] == keep))
    index = lambda name: exact_dedup.DigestIndex(spark, new_path(spark, name))
    for got in (exact_dedup.verdicts(docs, index("a")), exact_dedup.verdicts_of_batches(docs, index("b")), exact_dedup.verdicts_of_batches(docs, index("c"), 1)):
        assert keyed((bytes(r.digest).hex(), r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == keyed(want)
    assert exact_dedup.verdicts(none, index("d")).collect() == [] == exact_dedup.verdicts_of_batches(none, index("e")).collect()


def test_index_lasts_over_batches_and_sessions(spark, docs, none):
    path = new_path(spark, "kept-index")
    groups = len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in awkward_rows()})
    kept = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, path, 8), "first")
    assert kept.columns == docs.columns and kept.count() == groups
    later = spark.createDataFrame([(1000, "again"), (1001, "brand new"), (999, "brand  new"), (999, "brand new"), (999, "brand new"), (None, "null id")], "doc_id bigint, text string")
    other = spark.newSession()
    other.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).name}")  # a session that doesn't know it
    index = exact_dedup.DigestIndex(other, path)
    assert index.buckets == 8 and index.rows().count() == groups
    found = exact_dedup.deduplicate(later, index, "second").collect()
    assert [r.doc_id for r in found] == [999] and found[0].text.split() == ["brand", "new"]
    assert exact_dedup.deduplicate(later, index, "second").collect() == found  # the batch again, as after a failure
    assert exact_dedup.deduplicate(later, index).collect() == [] == exact_dedup.deduplicate(docs, index).collect()
    assert index.rows().count() == groups + 1 and exact_dedup.deduplicate(none, index).collect() == []


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_contiguous_and_balanced(docs, none, shards):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((r[1] or "").encode()) + 16 for r in rows]
    total, before, want, slots = sum(sizes), 0, [], {}
    for r, s in zip(rows, sizes, strict=True):
        shard = min(shards - 1, (2 * before + s) * shards // (2 * total))
        want.append((r[0], s, zlib.crc32((r[1] or "").encode()), shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += s
    assert keyed(sharding.assign_shards(docs, shards).collect()) == keyed(want)
    assert sharding.assign_shards(none).collect() == []


def library_ids(texts):
    library = Tokenizer.from_file(word_tokens.vocabulary_path())
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_tokens_equal_the_library():
    texts = [r[1] or "" for r in awkward_rows()] + ["'Re we'll ''s \xaa\xb5\xdf ŉ ǆ", "x\xady", "tab\there\x0b!?..\n"]
    got = word_tokens.WordTokens(word_tokens.vocabulary_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library_ids(texts)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_codes_give_every_id(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    codes = token_file.Codes(token_file.pack_codes(ids))
    assert codes.all().tolist() == ids.tolist() == [codes.at(i) for i in range(n)]


def test_token_file_round_trip(spark, docs, none):
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [x + [2] for x in library_ids([r[1] for r in rows])]
    path = new_path(spark, "tokens")
    token_file.write_tokens(docs, path, word_tokens.vocabulary_path(), segment=500)
    got = sorted(token_file.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows] and [r.n_tokens for r in got if r.doc_id == 41] == [1]
    starts = np.cumsum([0, *(r.n_tokens for r in got)])
    assert [r.start for r in got] == starts[:-1].tolist()
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert keyed((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == keyed((r[0], len(x), c) for r, x, c in zip(rows, ids, crc, strict=True))
    unique = [(i, r) for i, r in enumerate(got) if r.doc_id is not None and r.doc_id >= 60]
    places = [r.start + k for _, r in unique for k in (0, r.n_tokens // 2, r.n_tokens - 1)]
    by_id = {r[0]: x for r, x in zip(rows, ids, strict=True)}
    want = {r.start + k: by_id[r.doc_id][k] for _, r in unique for k in (0, r.n_tokens // 2, r.n_tokens - 1)}
    assert {r.place: r.token for r in token_file.tokens_at(spark, path, places).collect()} == want
    empty = new_path(spark, "tokens")
    token_file.write_tokens(none, empty, word_tokens.vocabulary_path())
    assert token_file.read_documents(spark, empty).collect() == []


def tiktoken_encoding():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library():
    library, own = tiktoken_encoding(), byte_bpe.ByteBpe(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = [r[1] or "" for r in awkward_rows()] + ["a" * 5000, "ab" * 700 + "!" * 301, "\U0001f600\u200b\u2003 x\x1c\x1d y  \n\n z"]
    texts += ["".join(rng.choice("abcdeéß \n'0%日") for _ in range(rng.randrange(1, 400))) for _ in range(200)]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_byte_bpe_round_trips(docs, none):
    library = tiktoken_encoding()
    want = []
    for r in awkward_rows():
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    path = public_tokenizers.path(byte_bpe.RANKS)
    assert keyed(byte_bpe.round_trips(docs, path).collect()) == keyed(want)
    assert byte_bpe.round_trips(none, path).collect() == []
    assert {len(r.ids) for r in byte_bpe.encode_documents(docs, path).where("doc_id = 51").collect()} == {1}


@pytest.mark.parametrize("group", [7, 100_000])
def test_packing_is_whole_and_tight(docs, none, group):
    rows = awkward_rows()
    found = packing.pack_documents(docs, word_tokens.vocabulary_path(), capacity=512, group=group).collect()
    want = []
    for r, ids in zip(rows, library_ids([r[1] for r in rows]), strict=True):
        ids = [*ids, 0]
        for k in range(0, len(ids), 512):
            want.append((r[0], k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())))
    assert keyed((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == keyed(want)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= 512
    if group > 7:
        assert len(bins) <= -(-sum(r.length for r in found) // 512) + 1
    assert packing.pack_documents(none, word_tokens.vocabulary_path()).collect() == []


def test_exchanges_beat_best_fit():
    bins = packing.Bins([6, 4, 5, 5, 3, 3, 4], 10)
    for items in ([0, 4], [1, 5], [2, 3], [6]):
        bins.change(bins.open(), into=items)
    assert packing.improve(bins, 3) == 1
    assert sum(1 for x in bins.items if x) == 3 and max(sum(bins.lengths[i] for i in x) for x in bins.items) <= 10


def fewest(lengths, capacity):
    """The least number of sequences, by trying every way."""
    best = [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                put(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_packing_of_few_pieces_is_as_tight_as_enumeration():
    rng, more = random.Random(4), []
    for _ in range(300):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        more.append(len(packing.pack_lengths(lengths, 20)[1]) - fewest(lengths, 20))
    assert min(more) == 0 and max(more) <= 1 and sum(more) <= 3


def test_search_empties_sequences_down_to_the_bound():
    rng = random.Random(2)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.1)) + 1) for _ in range(6000)]
    found, rooms, emptied = packing.pack_lengths(lengths)
    filled = [0] * len(rooms)
    for b, n in zip(found, lengths, strict=True):
        filled[b] += n
    assert emptied > 0 and len(rooms) == -(-sum(lengths) // 2048) and [2048 - n for n in filled] == rooms


def changed_copies(rng, n, base_words):
    """Texts and copies of them with text appended, cut off at the end, and words changed."""
    rows = []
    for g in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(base_words(rng))]
        k = len(base)
        for c, copy in enumerate((base, base + [f"a{rng.randrange(9999)}" for _ in range(rng.randrange(k // 5))], base[: k - rng.randrange(k // 5)], [w if rng.random() > 0.018 else "c" + w for w in base])):
            rows.append((10 * g + c, " ".join(copy)))
    return rows


def jaccard(a, b, shingle=5):
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute_groups(rows, least=0.8):
    label = {k: k for k, _ in rows}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if a // 10 == b // 10 and label[a] != label[b] and jaccard(x, y) >= least:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_appended_and_cut_copies_are_all_found(spark):
    rows = changed_copies(random.Random(3), 150, lambda rng: rng.randrange(60, 190))
    got = {r.doc_id: r.stays_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_groups(rows)
    assert len(set(want.values())) < 400 and got == want


def test_long_copies_are_decided_by_their_whole_shingle_sets(spark):
    rows = changed_copies(random.Random(4), 120, lambda rng: rng.randrange(300, 900))
    got = {r.doc_id: r.stays_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_groups(rows)


def test_near_copies_of_null_and_repeated_doc_ids(spark):
    text, other, third = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(None, text), (None, text.replace("a50", "x")), (None, other + " end"), (7, other), (7, third), (8, third + " end"), (None, "alone")]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in got) == [("7", "b"), ("7", "c"), ("None", "a"), ("None", "a")]
    assert (None, "alone") in got


def test_rows_of_a_hot_shingle_are_not_in_one_task(spark):
    F = simhash.F
    places = spark.range(6000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 997).alias("item")).repartition(4)
    got = simhash.meeting(Scratch(spark, "met"), places, "key")
    assert {tuple(r) for r in got.where("item = -1").select("low", "n").distinct().collect()} == {(0, 2000)} and got.count() == 6000
    per_task = [r.n for r in got.where("item = -1").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(per_task) < 1000
    pairs = places.where("item = -1").select(F.lit(0).cast("long").alias("a"), F.col("key").alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    met = join_spread(pairs, places.withColumnRenamed("key", "a"), "a", "b", 2000)
    assert met.count() == 2000 and max(r.n for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 1000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_share_the_fate_of_their_group(spark):
    text = " ".join(f"a{i}" for i in range(100))
    rows = [(3, text), (3, text), (4, text), (9, text + " end"), (1, "other"), (None, ""), (None, None)]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert keyed(got) == keyed([(3, text), (3, text), (1, "other"), (None, ""), (None, None)])
