"""Main text of HTML pages by a maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive and tags negative; one linear scan finds the contiguous
run with the highest sum, which is the content region. Words in containers that aren't content (menus, forms, adverts,
comments and so on) are tokens of their own kind that score at most zero, and are left out of the text. Some tags and
roles always name such containers; names in class and id have weights, and a container whose names' weights add up to
less than zero is one.

All weights come from labelled pages: pages that mark their article themselves. A name weighs as its containers hold
most of the marked article or none of it, from a prior that is low for names made of words like ``sidebar``. For the
token kinds a structured perceptron compares the run it finds with the marked one and shifts the weights by the
difference, keeping words positive and tags negative. Both are fitted on a bounded sample (SAMPLE pages, none over
LONGEST bytes) and applied to every page, labelled or not.

Defined cases: a null html counts as empty; a page without words gives the empty text; of runs with the same score the
first and shortest is taken; unclosed comments, scripts and containers run to the end of what encloses them; repeated
rows have the same text each; null page_ids and urls stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE, LONGEST = 200, 200_000
ROUNDS = 12

#: Elements of HTML by what they do to text.
RAW = ("script", "style", "noscript", "iframe", "textarea", "title")
OUTSIDE = frozenset("template svg select object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head nav footer aside form button menu dialog fieldset".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
SUSPECT = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay popup promo promoted promotion recommended "
    "related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that say nothing of what a container holds, beside those.
PLAIN = frozenset("area articles bar block box bottom button buttons container content form group header inner item items left link links list module outer page panel posts right row section site slot text top unit wrap wrapper".split())
#: Log-odds of a name before any page is seen: of suspect words, and of others.
PRIOR = (-1.5, 3.0)

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?"
    rf"|<({'|'.join(RAW)})(?=[\s/>])(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1\s*+>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S | re.I,
)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
class Weights(NamedTuple):
    """What a fit gives: weights of class and id names, and of token kinds."""

    names: dict[str, float] = {}
    kinds: dict[str, float] = {}


DEFAULT = {"word": 1.0, "word-a": 0.2, "word-out": -0.5}
#: Weights of tags before any page is seen: of others, of those inside lines, and of those around pieces of running
#: text, where a word must outweigh the two tags around it.
DEFAULT_TAG, DEFAULT_INLINE, DEFAULT_TEXT = -2.0, -0.2, -0.4
TEXT = frozenset("p br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table tbody tr td th".split())


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(text)}


def suspect(name: str) -> bool:
    """Whether a class or id is made of suspect words and plain ones only."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return any(x in SUSPECT for x in parts) and all(x in SUSPECT or x in PLAIN for x in parts)


def names_of(own: dict[str, str]) -> set[str]:
    return set(f"{own.get('class', '')} {own.get('id', '')}".split())


def never_content(name: str, own: dict[str, str], inside_article: bool, names: dict[str, float]) -> bool:
    """Whether an element is a container whose words aren't content. A header of an article is content."""
    if name in NEVER or own.get("role") in NEVER_ROLES:
        return True
    if name in ("html", "body", "main", "article"):
        return False
    if name == "header" and not inside_article:
        return True
    return sum(names[x] if x in names else -1.0 if suspect(x) else 0.0 for x in names_of(own)) < 0


def tokens(page: str, names: dict[str, float] | None = None, containers: list | None = None) -> list[tuple[str, str, bool]]:
    """(kind, word, marked) of every word and tag in page order; tags have no word.

    A word with a leading space starts apart from the one before. ``marked``: inside the page's own article. Elements
    of OUTSIDE give no tokens; without an end tag they end with what encloses them, self-closed svg and math at once.
    ``names`` weighs classes and ids. ``containers`` gets (names, first token, past the last) of elements that have names.
    """
    names = names or {}
    found: list[tuple[str, str, bool]] = []
    open_tags: list[tuple[str, bool, bool, set[str], int]] = []  # name, never content, article, names, first token
    open_names: Counter[str] = Counter()
    never = article = links = outside = 0
    apart, at = True, 0
    while at < len(page):
        tag = TAG.search(page, at)
        chunk = html.unescape(page[at : tag.start() if tag else len(page)])
        if chunk and not outside:
            kind = "word-out" if never else "word-a" if links else "word"
            words = chunk.split()
            for n, word in enumerate(words):
                gap = n > 0 or apart or chunk[0].isspace()
                found.append((kind, " " + word if gap else word, article > 0))
            apart = chunk[-1].isspace() or (apart and not words)
        if not tag:
            break
        at = tag.end()
        name = (tag[3] or tag[6] or "").lower()
        if not name:
            continue
        if name not in INLINE and name not in OUTSIDE and not outside:
            apart = True
        if tag[2] or tag[5]:
            while open_names[name]:  # closes what was left open inside, too
                last = open_tags.pop()
                open_names[last[0]] -= 1
                never, article, links = never - last[1], article - last[2], links - (last[0] == "a")
                outside -= last[0] in OUTSIDE
                if containers is not None and last[3]:
                    containers.append((last[3], last[4], len(found)))
                if last[0] == name:
                    break
            if name not in OUTSIDE and not outside:
                found.append((f"/{name}", "", article > 0))
            continue
        alone = name in VOID or (name in ("svg", "math") and SELF_CLOSED.search(tag[4] or tag[7] or ""))
        if outside or name in OUTSIDE:
            if not alone:
                open_tags.append((name, False, False, set(), len(found)))
                open_names[name] += 1
                outside, links = outside + (name in OUTSIDE), links + (name == "a")
            continue
        own = attributes(tag[4] or tag[7] or "")
        out = never_content(name, own, article > 0, names)
        first = len(found)
        found.append((name, "", article > 0))
        if not alone:
            marks = name in ("article", "main") or own.get("role") in ("article", "main") or "articlebody" in own.get("itemprop", "")
            open_tags.append((name, out, marks, names_of(own), first))
            open_names[name] += 1
            never, article, links = never + out, article + marks, links + (name == "a")
    if containers is not None:
        containers.extend((x[3], x[4], len(found)) for x in open_tags if x[3])
    return found


def name_weights(pages: list[str]) -> dict[str, float]:
    """Log-odds that a container of a name is content, from the pages where it holds most of the marked article, and none of it.

    Containers that lie inside the article, as adverts in it do, tell nothing.
    """
    holds: Counter[str] = Counter()
    lacks: Counter[str] = Counter()
    for page in pages:
        containers: list[tuple[set[str], int, int]] = []
        found = tokens(page, {}, containers)
        marked = [0]
        words = [0]
        for _, word, inside in found:
            marked.append(marked[-1] + (inside and bool(word)))
            words.append(words[-1] + bool(word))
        if not marked[-1]:
            continue
        seen = {True: set(), False: set()}
        for names, a, b in containers:
            own = marked[b] - marked[a]
            if 2 * own >= marked[-1]:
                seen[True] |= names
            elif not own and words[b] > words[a]:
                seen[False] |= names
        holds.update(seen[True])
        lacks.update(seen[False] - seen[True])
    return {x: PRIOR[not suspect(x)] + math.log((holds[x] + 1) / (lacks[x] + 1)) for x in holds.keys() | lacks.keys()}


def weight_of(weights: dict[str, float], kind: str) -> float:
    found = weights.get(kind)
    if found is not None:
        return found
    name = kind.lstrip("/")
    return DEFAULT.get(kind, DEFAULT_INLINE if name in INLINE else DEFAULT_TEXT if name in TEXT else DEFAULT_TAG)


def best_run(found: list[tuple[str, str, bool]], weights: dict[str, float]) -> tuple[int, int]:
    """(first, past the last) of the run with the highest sum; (0, 0) if none is positive."""
    best, total, start, run = 0.0, 0.0, 0, (0, 0)
    for i, (kind, _, _) in enumerate(found):
        if total <= 0:
            total, start = 0.0, i
        total += weight_of(weights, kind)
        if total > best:
            best, run = total, (start, i + 1)
    return run


def fit(pages: list[str], rounds: int = ROUNDS) -> Weights:
    """Weights of names and, by an averaged structured perceptron, of token kinds, from pages that mark their article."""
    names = name_weights(pages)
    return Weights(names, _kind_weights([tokens(page, names) for page in pages], rounds))


def _kind_weights(pages: list[list[tuple[str, str, bool]]], rounds: int) -> dict[str, float]:
    labelled = []
    for found in pages:
        inside = [i for i, (kind, word, marked) in enumerate(found) if marked and word and kind != "word-out"]
        if inside:
            labelled.append((found, (inside[0], inside[-1] + 1)))
    weights: dict[str, float] = {}
    total: Counter[str] = Counter()
    steps = 0
    for _ in range(rounds):
        wrong = 0
        for found, (a, b) in labelled:
            c, d = best_run(found, weights)
            if (c, d) != (a, b):
                wrong += 1
                gold, got = Counter(k for k, _, _ in found[a:b]), Counter(k for k, _, _ in found[c:d])
                for kind in gold.keys() | got.keys():
                    # words move within bounds, so that tags have to learn what ends the content
                    moved = weight_of(weights, kind) + 0.5 * max(-8, min(8, gold[kind] - got[kind]))
                    low, high = (0.1, 1.0) if kind in ("word", "word-a") else (-1.0, 0.0) if kind == "word-out" else (-1000.0, -0.05)
                    weights[kind] = max(low, min(high, moved))
            steps += 1
            for kind, w in weights.items():
                total[kind] += w
        if not wrong:
            return weights
    return {kind: w / steps for kind, w in total.items()} if steps else {}


def main_text(page: str | None, weights: Weights) -> str:
    found = tokens(page or "", weights.names)
    a, b = best_run(found, weights.kinds)
    return " ".join("".join(word for kind, word, _ in found[a:b] if word and kind != "word-out").split())


def labelled_sample(pages: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Up to ``sample`` pages that mark their article, of up to LONGEST bytes, chosen by a hash of the page_id."""
    marked = pages.where(F.regexp_like("html", F.lit("(?i)<article|<main|articlebody")) & (F.octet_length("html") <= LONGEST)).select("html", F.xxhash64("page_id", "url").alias("at"))
    # the places alone go through the sort, so that a task sends no more than ``sample`` numbers
    chosen = marked.select("at").orderBy("at").limit(sample).distinct()
    return [r.html for r in marked.join(F.broadcast(chosen), "at").groupBy("at").agg(F.min("html").alias("html")).orderBy("at").collect()]


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch["html"].to_pylist()]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(labelled_sample(pages)))
