"""Extraction, PII, toxicity, fingerprints and the pipeline on small, awkward tables."""

import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

import corpus_pipeline
from gaugeworks.llm import exact_dedup, extraction, fingerprint, pii, simhash, toxicity
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def keyed(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- extraction

ARTICLE = "<h1>Big  News</h1><p>First paragraph of<br>the story &amp; <b>mo</b>re words here.</p><p>Second one follows, with <a href='x'>a link</a> in it.</p>"
SHELL = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a> <a>About us</a></nav><div class='cookie-notice'>We use cookies on this site today.</div>"
    "<aside>Side words that nobody needs to read.</aside>%s<form><label>Name</label><button>Send it</button></form><section id='comments'><p>Great article, I loved all of it.</p></section>"
    "<footer>&copy; Someone somewhere</footer><script>var x = '<p>no</p>';</script></body></html>"
)
TEXT = "Big News First paragraph of the story & more words here. Second one follows, with a link in it."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "<article>%s<div class='ad'>Buy now, really.</div></article>"])
def test_article_without_what_surrounds_it(wrap):
    pages = [SHELL % ("<article>%s</article>" % ARTICLE)] * 3
    assert extraction.main_text(SHELL % (wrap % ARTICLE), extraction.fit(pages)) == TEXT


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"), ("<!-- never closed <p>x</p>", ""), ("<script>x", ""), ("a < b > c", "a < b > c"), ("<p>x&nbsp;&#8364;</p>", "x €")])
def test_odd_pages(page, want):
    assert extraction.main_text(page, extraction.Weights()) == want


def test_best_run_is_the_best_of_all_runs():
    rng = random.Random(2)
    for _ in range(50):
        found = [(rng.choice(["word", "word-a", "p", "div", "word-out"]), "x", False) for _ in range(rng.randrange(1, 25))]
        weights = {"word": 1.0, "p": -0.5, "div": -2.0, "word-a": 0.2, "word-out": -0.3}
        sums = {(i, j): sum(weights[k] for k, _, _ in found[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)}
        i, j = extraction.best_run(found, weights)
        assert abs(sum(weights[k] for k, _, _ in found[i:j]) - max(0, *sums.values())) < 1e-9


def test_extraction_of_a_table(spark):
    schema = "page_id bigint, url string, html string, text string"
    rows = [(1, "u", SHELL % f"<article>{ARTICLE}</article>", "other"), (None, None, None, None), (2, "v", "<p>x</p>", "o"), (2, "v", "<p>x</p>", "o")]
    pages = spark.createDataFrame(rows, schema)
    got = extraction.extract(pages, extraction.fit(extraction.labelled_sample(pages)))
    assert keyed(got.collect()) == keyed([(1, "u", TEXT, len(TEXT)), (None, None, "", 0), (2, "v", "x", 1), (2, "v", "x", 1)])
    assert extraction.extract(pages.limit(0), extraction.Weights()).collect() == [] and extraction.labelled_sample(pages.limit(0)) == []


class Article(HTMLParser):
    """Text of a page's article without adverts, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.open, self.parts = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in extraction.VOID:
            self.parts.append(" " * (tag == "br"))
            return
        out = dict(attrs).get("class") == "ad" or tag in ("script", "style", "nav")
        self.open.append((tag, out))
        self.depth, self.skip = self.depth + (tag == "article"), self.skip + out
        self.parts.append(" " * (tag not in extraction.INLINE))

    def handle_endtag(self, tag):
        while any(x == tag for x, _ in self.open):  # elements that were left open end with it
            last, out = self.open.pop()
            self.depth, self.skip = self.depth - (last == "article"), self.skip - out
            if last == tag:
                break
        self.parts.append(" " * (tag not in extraction.INLINE))

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def test_held_out_pages_with_and_without_their_mark(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    fitted, held, right, unmarked = pages[::2], pages[1::2], 0, 0
    weights = extraction.fit(fitted[:100])
    for page in held:
        parser = Article()
        parser.feed(page)
        want = " ".join("".join(parser.parts).split())
        right += extraction.main_text(page, weights) == want
        unmarked += extraction.main_text(page.replace("<article", "<div").replace("</article", "</div"), weights) == want
    assert len(held) > 100 and right == len(held) and unmarked / len(held) > 0.95


def test_names_are_weighed_by_what_they_hold():
    body = " ".join(f"word{i}" for i in range(60))
    assert [extraction.suspect(x) for x in ("sidebar-left", "ad", "social-history", "related-work", "share-buttons")] == [True, True, False, False, True]
    page = f'<html><body><div class="social-history"><p>{body}</p></div><div class="comments">{body} {body}</div></body></html>'
    assert extraction.main_text(page, extraction.Weights()) == body
    holding = [f'<div class="widget"><article><p>{body}</p><div class="ad">buy it</div></article></div><div class="zone7"><p>{body}</p></div>'] * 30
    weights = extraction.fit(holding)
    assert weights.names["widget"] > 0 > weights.names["zone7"] and "ad" not in weights.names
    assert extraction.main_text(f'<div class="widget"><p>{body}</p></div><div class="zone7"><p>other</p></div><div class="ad">buy</div>', weights) == body
    assert extraction.main_text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", extraction.Weights()) == "so x=2 holds"


def test_stray_ends_in_deep_nesting_cost_about_their_number():
    def seconds(n):
        began = time.monotonic()
        extraction.tokens("<b>" * n + "</i>" * n)
        return time.monotonic() - began

    seconds(1000)
    assert seconds(16000) < 4 * seconds(8000) + 0.2


def test_very_long_pages_are_read_whole(spark):
    words = " ".join(f"word{i}" for i in range(100_000))
    page = SHELL % f"<article><p>{words}</p></article>"
    docs = spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")
    assert extraction.extract(docs, extraction.fit([SHELL % f"<article>{ARTICLE}</article>"] * 3)).first().text == words


# --- PII

BRUTE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BRUTE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def pii_texts():
    rng = random.Random(4)
    texts = [None, "", "a@b.c@d.e_f@g.h", "x 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "é\U0001f600 4111 1111-1111 1111 +1 (555) 123-4567.", "4111111111111112", "+12 34", "9" * 3000, "a" * 3000 + "@", "+1" + " 2" * 30]
    texts += ["".join(rng.choice("0123456789.@+- ()aZ_é") for _ in range(rng.randrange(300))) for _ in range(150)]
    return [*texts, "say hi to me@example.com", "say hi to me@example.com"]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(pii_texts())], "doc_id bigint, text string, start int, hit string")
    found = docs.select("doc_id", *[pii.base_spans(F.coalesce("text", F.lit("")), k).alias(k) for k in pii.BASE])
    for r in found.collect():
        assert [f"{k}:{m.start}:{m.end}" for k in pii.BASE for m in r[k]] == brute_spans(pii_texts()[r.doc_id])


def test_labelers_teach_the_classifier(spark):
    rng = random.Random(6)
    rows, keys = [], []
    for i in range(60):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        keys.append(key)
        rows.append((i, f'some words token = "{key}" and more'))
    rows += [(100 + i, f"the file report_{i}_of_the_year_2020_final was sent, fine") for i in range(60)] + [(None, None), (500, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: [m.hit for m in r.spans.secret] for r in pii.find(docs).collect()}
    assert [got[i] for i in range(60)] == [[k] for k in keys] and not any(got[100 + i] for i in range(60)) and got[None] == got[500] == []
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 3").first().text == 'some words token = "[SECRET]" and more'
    assert clean.where("doc_id is null").first().text is None and pii.redact(docs.limit(0)).collect() == []


def number_texts(n):
    """(text, the personal number in it or None), in many shapes."""
    rng, rows = random.Random(12), []
    for i in range(n):
        a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        if i % 2:
            hit = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}-{b % 90 + 10}-{c}"])
            rows.append((f"We met. {rng.choice(['Call me at', 'phone:', 'my ssn is', 'Fax', 'mobile no.'])} {hit} some day.", hit))
        else:
            other = rng.choice([f"on 20{b % 90 + 10}-11-{b % 18 + 10}", f"for ${a} {b} {a % 90 + 10}", f"pages {c} {c + 9} of it", f"about {c}-{c + 80} years", f"part {c}.{a}.{b % 90 + 10}"])
            rows.append((f"It was {other} as they said.", None))
    return rows


def test_numbers_found_on_rows_that_were_not_fitted(spark):
    rows = number_texts(600)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    models = pii.train(docs.where("doc_id < 300"))
    held = docs.where("doc_id >= 300").select("doc_id", pii.added_spans(F.col("text"), "number", models["number"]).alias("found")).collect()
    hits = [([m.hit for m in r.found], rows[r.doc_id][1]) for r in held]
    right = sum(want in got for got, want in hits if want)
    assert right / sum(want is not None for _, want in hits) > 0.9 and right / max(1, sum(len(got) for got, _ in hits)) > 0.9
    report = {(r.kind, r.labeler): r for r in pii.reliability_report(spark, models).collect()}
    assert len(report) == 3 and all(0 < r.rate_false < r.rate_true < 1 for r in report.values() if r.labeler != "context")


def test_reliabilities_come_near_the_true_ones():
    rng, counts, true = random.Random(3), {}, [(0.9, 0.05), (0.7, 0.1), (0.6, 0.2)]
    for _ in range(20000):
        y = rng.random() < 0.3
        v = tuple(-1 if rng.random() < 0.1 else int(rng.random() < (t if y else f)) for t, f in true)
        counts[v] = counts.get(v, 0) + 1
    prior, rates, posterior = pii.reliabilities(counts)
    assert abs(prior - 0.3) < 0.05 and all(abs(a - x) < 0.06 and abs(b - y) < 0.06 for (a, b), (x, y) in zip(rates, true, strict=True))
    assert posterior[1, 1, 1] > 0.95 and posterior[0, 0, 0] < 0.1


def test_spans_of_a_text_cost_about_their_number(spark):
    def seconds(n):
        text = " ".join(f"4111111111111111 me{i}@x.org" for i in range(n))
        docs = spark.createDataFrame([(1, text, len(text))], "doc_id bigint, text string, n_chars bigint").select("*")
        took = []
        for _ in range(2):
            began = time.monotonic()
            got = pii.redact(docs).first()
            took.append(time.monotonic() - began)
        assert got.text == " ".join(["[CARD] [EMAIL]"] * n)
        return min(took)

    seconds(100)
    assert seconds(8000) < 3 * seconds(4000) + 1


def test_clashing_names_are_no_trouble(spark):
    names = ["doc_id", "text", "spans", "clean", "_email", "_secret", "near_id", "near_mark", "exact_id", "exact_mark", "mark", "key", "label", "n"]
    docs = spark.createDataFrame([(1, "me@x.org", *range(12)), (2, "me@x.org", *range(12)), (2, "me@x.org", *range(12)), (None, None, *range(12))], ", ".join(f"{c} {'string' if c == 'text' else 'bigint'}" for c in names))
    for step in (pii.redact, simhash.deduplicate, exact_dedup.deduplicate):
        got = step(docs)
        assert got.columns == docs.columns and {r.n for r in got.collect()} == {11}
    assert exact_dedup.deduplicate(docs).count() == 2


def test_redaction_of_overlaps_and_n_chars(spark):
    docs = spark.createDataFrame([(1, "é 4111111111111111 me@x.org +4111111111111", 9), (2, "none", 4)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert got[2] == ("none", 4) and got[1][0].startswith("é [CARD] [EMAIL] ") and got[1][1] == len(got[1][0]) and "4111" not in got[1][0]


# --- toxicity


def test_gradients_equal_finite_differences():
    net, rng = toxicity.Network(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask, y = rng.standard_normal((3, 5, toxicity.WIDTH)), np.ones((3, 5)), np.array([1.0, 0, 1])
    mask[1, 3:] = 0

    def loss():
        z = net.run({d: x @ net.p[f"W{d}"] + net.p[f"b{d}"] for d in "fb"}, mask)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    got, _ = net.gradients(x, mask, y)
    for k in ("Wf", "Wb", "Uf", "Ub", "bf", "bb", "A", "v", "u", "c"):
        i = np.unravel_index(3 % net.p[k].size, net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        assert abs((up - loss()) / 2e-3 - got[k][i]) < 1e-4
        net.p[k][i] = old


def test_all_of_a_long_word_is_read():
    long = "ab" * 30
    split = lambda w: toxicity.WORD.findall(w)
    assert "".join(split(long)) == long and [toxicity.features(w) for w in split(long + "x")] != [toxicity.features(w) for w in split(long + "y")]


def test_features_of_many_words_are_those_of_each(monkeypatch):
    words = ["a", "ab", "äöü", "x" * 40, "\U0001f600\U0001f601", "\ud800z", "abab", "a", "0"]
    seen = []
    monkeypatch.setattr(toxicity, "_places", type("Seen", (toxicity.Places,), {"__missing__": lambda self, gram: seen.append(gram) or toxicity.Places.__missing__(self, gram)})())
    own, grams, many = toxicity.all_features(words)
    want = [(f"^{w}$", [f"^{w}$"[i : i + 3] for i in range(len(w))]) for w in words]
    place = lambda text, start, size: zlib.crc32(text.encode("utf-8", "surrogatepass"), start) % size
    assert own.tolist() == [place(w, 0, toxicity.WORDS) for w, _ in want] and many.tolist() == [len(g) for _, g in want]
    assert grams.tolist() == [place(g, 1, toxicity.GRAMS) for _, each in want for g in each]
    assert len(seen) == len(set(seen))  # no trigram is hashed twice


def test_scores_are_those_of_the_network_over_all_windows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts = ["", "one", *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 400))) for _ in range(20)], " ".join(rng.choice(words) for _ in range(30000))]
    params = toxicity.train(texts[:12], [0, 1] * 6, rounds=2)
    network, want = toxicity.Network(), []
    network.p = params
    for text in texts:
        parts, best = toxicity.WORD.findall(text.lower()), -np.inf
        for a in toxicity.windows(len(parts)):
            own = parts[a : a + toxicity.WINDOW]
            x = np.zeros((1, toxicity.WINDOW, toxicity.WIDTH))
            for k, (w, grams) in enumerate(map(toxicity.features, own)):
                x[0, k] = params["E"][w] + params["C"][grams].mean(axis=0)
            mask = np.array([[1.0] * len(own) + [0.0] * (toxicity.WINDOW - len(own))])
            best = max(best, float(network.run({d: x @ params[f"W{d}"] + params[f"b{d}"] for d in "fb"}, mask)[0]))
        want.append(1 / (1 + np.exp(-best)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, params).collect()}
    assert all(abs(got[i] - w) < 1e-4 for i, w in enumerate(want))


@pytest.mark.parametrize("n", [0, 1, 32, 33, 56, 57, 500])
def test_windows_cover_every_word(n):
    covered = {i for a in toxicity.windows(n) for i in range(a, min(n, a + toxicity.WINDOW))}
    assert covered == set(range(n)) and toxicity.windows(n)[0] == 0


def toxic_tables(spark, n=400):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        if i % 4 == 0:
            for _ in range(1 + len(text) // 40):
                text.insert(rng.randrange(len(text)), rng.choice(["zonkhead", "zonkface", "grumblefink"]))
        docs.append((i, " ".join(text), "en", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(None, None, "en", 1), (n + 1, "", "en", 1), (n + 2, "zonkbrain you", "en", 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_tables(spark)
    params = toxicity.learn(docs, labels)
    got = toxicity.score(docs, params).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in known)
    held = [r for r in known if r.held_out]
    assert len(held) > 50 and sum((r.doc_id % 4 == 0) == r.predicted for r in held) / len(held) > 0.95
    assert {r.predicted for r in got if r.doc_id in (None, 401)} == {0}
    kept = toxicity.keep_clean(docs, params)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark, 8)
    params = toxicity.learn(docs, labels.where("toxic = 0"))
    assert params is None and {r.score for r in toxicity.score(docs, params).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), params).collect() == []


# --- fingerprints


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_tree(text):
    """(root, sections), a section (node, paragraphs), a paragraph (node, leaves)."""
    sections = []
    for s in text.split("\n\n"):
        paragraphs = []
        for p in s.split("\n"):
            leaves, at = [], 0
            while at < len(p):
                low, high = at + fingerprint.SHORTEST, at + fingerprint.LONGEST
                ends = [e for e in range(low + 1, min(len(p), high + 1) + 1) if p[e - 1] in "、。"] + [e for e in range(low + 2, min(len(p), high + 2) + 1) if p[e - 1] in " \t" and p[e - 2] in "aenrst.,"]
                if low <= len(p) <= high:
                    ends.append(len(p))
                end = min(ends, default=min(len(p), high))
                leaves.append(sha(p[at:end]))
                at = end
            paragraphs.append((sha(".".join(leaves)), leaves))
        sections.append((sha(",".join(n for n, _ in paragraphs)), paragraphs))
    return sha(";".join(n for n, _ in sections)), sections


def written(tree):
    return tree[0] + ":" + ";".join(n[:16] + "=" + ",".join(m[:16] + "".join("." + x[:8] for x in leaves) for m, leaves in ps) for n, ps in tree[1])


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    below = lambda nodes: [c for _, cs in nodes for c in cs]
    key = lambda node: repr(node)
    only = lambda x, y: [n for n in x if key(n) not in {key(m) for m in y}]
    pa, pb = below(only(a[1], b[1])), below(only(b[1], a[1]))
    la, lb = set(below(only(pa, pb))), set(below(only(pb, pa)))
    n = sum(len(set(below(below(t[1])))) for t in (a, b))
    return max(0.0, 1 - max(1, len(la - lb) + len(lb - la)) / max(1, n))


def fingerprint_rows():
    rng = random.Random(3)
    words = ["the", "stone", "Ämt", "in", "of。", "walks", "x", "一二、三", "end."]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n"]) for _ in range(rng.randrange(60)))
    rows = [(i, make(), "x") for i in rng.sample(range(10**6), 50)] + [(i, " ".join(rng.choice(words) for _ in range(4000)), "x") for i in (10**7, 10**7 + 1)]
    return rows + [(7, "same", "x"), (8, "same", "x"), (-5, None, "x"), (-6, "", "x"), (9, "é\U0001f600" * 400, "x"), (10, "\n\n\n", "x")]


def test_op10_equals_brute_force(spark, tmp_path):
    rows = fingerprint_rows()
    spark.createDataFrame(rows, "doc_id bigint, text string, after string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    ordered = sorted(rows, key=lambda r: -r[0])
    want = []
    for i, (doc_id, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own, new, other = map(brute_tree, (text, edited, after))
        want.append((doc_id, len(text), sha(edited), written(own), written(new), round(brute_likeness(own, new), 9), round(brute_likeness(own, other), 9)))
    got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprint.op10_fingerprints(spark, str(tmp_path)).collect()]
    assert keyed(got) == keyed(want)
    long = [r for r in got if r[1] > 10000]
    assert len(long) == 2 and all(0.3 < r[5] < 0.9 for r in long)


def test_order_of_null_and_only_rows(spark):
    docs = spark.createDataFrame([(None, f"null {i}") for i in range(40)] + [(3, "three"), (7, "same"), (7, "a")], "doc_id bigint, text string").repartition(3)
    got = fingerprint.with_next(docs).collect()
    after = {(r.doc_id, r.text): r.after for r in got}
    assert len(got) == 43 and sorted(r.after for r in got) == sorted(r.text for r in got)
    assert after[7, "a"] == "same" and after[7, "same"] == "three" and after[3, "three"].startswith("null") and sum(v == "a" for v in after.values()) == 1
    assert fingerprint.with_next(docs.limit(0)).collect() == [] and [tuple(r) for r in fingerprint.with_next(docs.where("doc_id = 3")).collect()] == [(3, "three", "three")]


def test_likeness_of_moved_and_shifted_paragraphs(spark):
    rng = random.Random(5)
    p, q = (" ".join("".join(rng.choice("abcdenrst") for _ in range(6)) for _ in range(90)) for _ in "pq")
    cases = [(f"{p}\n{q}", f"{q}\n{p}", 0.9, 0.999), (p, "X" + p, 0.8, 0.999), (f"{p}\n\n{q}", f"{p}\n\n{q}", 1, 1), (p, q, 0, 0), ("", p, 0, 0), ("", "", 1, 1), ("a", "b", 0, 0), ("a\nb", "a\n\nb", 0.4, 0.8)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string")
    for r in df.select("i", fingerprint.likeness(fingerprint.tree(F.col("a")), fingerprint.tree(F.col("b"))).alias("x"), fingerprint.likeness(fingerprint.tree(F.col("b")), fingerprint.tree(F.col("a"))).alias("y")).collect():
        assert cases[r.i][2] <= r.x <= cases[r.i][3] and r.x == r.y, cases[r.i]


def test_edits_are_located_by_differing_branches(spark):
    make = lambda rows: fingerprint.trees(spark.createDataFrame(rows, "doc_id bigint, text string"))
    old = make([(1, "a\nb\n\nc"), (2, "same"), (3, "x\n\ny\nz")])
    new = make([(1, "a\nB\n\nc"), (2, "same"), (3, "new\n\nx\n\ny\nz"), (4, "only here")])
    assert keyed(fingerprint.edits(old, new).collect()) == [(1, 0, 1), (3, 0, 0), (4, 0, 0)]


@pytest.mark.parametrize(
    "page,want",
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', "one two three"),
        ("<p>one <math/> two</p>", "one two"),
        ("<p>one <svg><path d='x'/><path/><text>no</text></svg> two</p>", "one two"),
        ("<aside><select><option>no</aside><p>one two three four five six</p>", "one two three four five six"),
        ("<div><object data=x>no</div><p>one two three four five six</p>", "one two three four five six"),
    ],
)
def test_elements_without_content_end_with_what_encloses_them(page, want):
    found = extraction.tokens(page)
    assert " ".join("".join(w for k, w, _ in found if k != "word-out").split()) == want


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_tables(spark)
    base = docs.select("doc_id", "text", "lang").withColumn("source", F.lit("s")).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))
    words = " ".join(f"word{i}" for i in range(100))
    extra = [(1000, "hello there", "en", "s", 11), (1001, "hello  there", "en", "s", 12), (1002, words, "en", "s", 1), (1003, words.replace("word50", "changed"), "en", "s", 1), (1004, "write to me@example.com", "en", "s", 1)]
    base = base.unionByName(spark.createDataFrame(extra, base.schema))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = now
        if i < 4:
            assert now.columns == base.columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    toxic = {i for i in range(0, 400, 4)}
    assert len(toxic & ids("toxicity")) < 5 and len(ids("toxicity") & set(range(400)) - toxic) > 290
    assert {1000, 1001} & ids("exact dedup") == {1000} and {1002, 1003} & ids("near dedup") == {1002}
    assert seen["pii"].where("doc_id = 1004").first().text == "write to [EMAIL]" and ids("pii") == ids("near dedup") == ids("packing")
    total = seen["packing"].selectExpr("sum(length) as n", "count(distinct sequence_id) as s").first()
    assert total.s <= -(-total.n // 2048) + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_evidence_is_bounded_whatever_the_texts_hold(spark):
    rng = random.Random(11)
    token = lambda: "-".join("".join(rng.choice("abcXYZ0123456789") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(2, 7)))
    number = lambda: rng.choice(" .-").join("".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(2, 6)))
    texts = [" ".join(rng.choice(["key=", "tel ", ""]) + rng.choice([token, number])() for _ in range(400)) for _ in range(100)]
    found = pii.evidence(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert 100 < found.count() < 1000
    assert found.where("name = ''").selectExpr("sum(n)").first()[0] > 10_000


def test_clashing_names_of_keys(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "y"), (2, "a  b", "x", "y"), (3, "c", "x", "y")], "doc_id bigint, text string, _of_exact_id string, _of_0 string")
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(rows).collect()) == [1, 3]
    near = rows.withColumnRenamed("_of_exact_id", "_of_near_id")
    assert simhash.deduplicate(near).columns == near.columns and simhash.deduplicate(near).count() == 2  # one of two equal texts goes
