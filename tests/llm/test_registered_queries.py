"""Every registered query of the subpackage, with its final columns, on small awkward tables; and the pipeline on empty ones."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from test_content_operators import SHELL, brute_spans, toxic_tables
from test_text_operators import SCHEMA, awkward_rows, brute_components, keyed, library_ids, tiktoken_encoding

import corpus_pipeline
from gaugeworks.llm import packing
from gaugeworks.llm.common import documents, stage
from gaugeworks.llm.queries import QUERIES

ROWS = [*awkward_rows(), *[(80 + i, t, "en", "d", 1, 2, 3, 4) for i, t in enumerate(["mail me@x.org or +1 (555) 123-4567, 4111 1111 1111 1111", "10.0.0.1 300.1.1.1", "é\U0001f600 a.b@c.de"])]]
TEXTS = [r[1] or "" for r in ROWS]
#: In ascending order nulls come first, as in the token file and the shards.
ASCENDING = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    article = "<article><h1>Head</h1><p>" + "word " * 50 + "</p></article>"
    pages = [(1, "u", SHELL % article), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", SHELL % article)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def got(spark, folder, name, *columns):
    df = QUERIES[name](spark, folder)
    assert df.columns[: len(columns)] == list(columns)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_op1(spark, folder):
    assert keyed(got(spark, folder, "op1_simhash", "doc_id", "fingerprint", "component_id")) == keyed(brute_components(ROWS))


def test_op2(spark, folder):
    ids = {id(r): [*x, 2] for r, x in zip(ROWS, library_ids(TEXTS), strict=True)}
    found = sorted(got(spark, folder, "op2_token_file", "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r[1])
    assert [r[0] for r in found] == [r[0] for r in ASCENDING] and [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    want = [(r[0], len(ids[id(r)]), zlib.crc32(np.array(ids[id(r)], "<u4").tobytes())) for r in ROWS]
    assert keyed((r[0], *r[2:]) for r in found) == keyed(want)


def test_op3(spark, folder):
    text = "Head " + " ".join(["word"] * 50)
    want = [(1, "u", text, len(text)), (2, None, "", 0), (3, "v", "", 0), (3, "v", "", 0), (None, "w", text, len(text))]
    assert keyed(got(spark, folder, "op3_extraction", "page_id", "url", "text", "n_chars")) == keyed(want)


def test_op4(spark, folder):
    size = lambda r: len((r[1] or "").encode()) + 16
    rows = sorted(ASCENDING, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), size(r)))
    total, before, slots, want = sum(map(size, rows)), 0, {}, []
    for r in rows:
        shard = min(39, (2 * before + size(r)) * 40 // (2 * total))
        want.append((r[0], size(r), zlib.crc32((r[1] or "").encode()), "bytes", shard, slots.setdefault(shard, 0), None))
        slots[shard] += 1
        before += size(r)
    assert keyed(got(spark, folder, "op4_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")) == keyed(want)


def test_op5(spark, folder):
    library, sha = tiktoken_encoding(), lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for r, t in zip(ROWS, TEXTS, strict=True) for ids in [library.encode_ordinary(t)]]
    assert keyed(got(spark, folder, "op5_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == keyed(want)


def test_op6(spark, folder):
    want = []
    for r, t in zip(ROWS, TEXTS, strict=True):
        base = brute_spans(t)
        want.append((r[0], *[sum(x.startswith(f"{k}:") for x in base) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base)))
    found = got(spark, folder, "op6_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    kept = lambda spans: ",".join(x for x in spans.split(",") if x.split(":")[0] not in ("secret", "number"))
    assert keyed((*r[:6], kept(r[6])) for r in found) == keyed(want) and sum(r[1] > 0 for r in found) == 2


def test_op7(spark, folder):
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in TEXTS]
    groups = {}
    for r, t in zip(ROWS, texts, strict=True):
        groups.setdefault(t, []).append(r[0])
    low = {t: min((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    want = [(r[0], low[t], len(groups[t]), r[0] == low[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(ROWS, texts, strict=True)]
    assert keyed(got(spark, folder, "op7_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == keyed(want)


def test_op8(spark, folder):
    want = []
    for r, ids in zip(ROWS, library_ids(TEXTS), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want += [(r[0], k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    found = got(spark, folder, "op8_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert keyed(r[:5] for r in found) == keyed(want)
    bins = {}
    for r in found:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    assert all([a for a, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist() and sum(n for _, n in b) <= 2048 for b in bins.values())
    assert len(bins) == -(-sum(r[3] for r in found) // 2048)


def test_op9(spark, tmp_path):
    docs, labels = toxic_tables(spark, 200)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = got(spark, str(tmp_path), "op9_toxicity", "doc_id", "held_out", "score", "predicted")
    assert len(found) == docs.count() and all(0 <= r[2] <= 1 and r[3] == (r[2] >= 0.5) and r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r[1] and r[0] < 200]
    assert sum((r[0] % 4 == 0) == r[3] for r in held) / len(held) > 0.9


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n != "op3_extraction"])
def test_queries_of_empty_tables(spark, tmp_path, name):
    docs, labels = toxic_tables(spark, 4)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_pipeline_of_empty_tables_and_null_texts(spark, tmp_path):
    _, labels = toxic_tables(spark, 4)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rows = [(1, None, "en", "s", None), (None, None, "en", "s", 0), (None, "one", None, None, 3), (2, "", "en", "s", 0), (3, "two words", "en", "s", 9), (3, "two words", "en", "s", 9)]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length").collect()
    assert keyed(found) == keyed([(1, 1), (None, len(library_ids(["one"])[0]) + 1), (3, len(library_ids(["two words"])[0]) + 1)])


@pytest.mark.parametrize(("size", "least"), [("0.01", 442), ("0.1", 4539)])
def test_op8_reaches_the_least_number_on_the_given_tables(spark, size, least):
    found = QUERIES["op8_packing"](spark, f"/root/testdata/sf{size}").selectExpr("count(distinct sequence_id) as n", "sum(length) as total").first()
    assert -(-found.total // 2048) == least == found.n


@pytest.mark.parametrize(("group", "lost"), [(1000, 1), (100, 6)])
def test_small_groups_lose_hardly_anything(spark, group, lost):
    parts = stage(packing.pieces(documents(spark, "/root/testdata/sf0.01"), packing.vocabulary_path()), "pieces")
    found = packing.pack(parts, group=group).selectExpr("count(distinct sequence_id) as n", "sum(length) as total", "count(*) as rows").first()
    assert found.rows == parts.count() and found.n <= -(-found.total // 2048) + lost
