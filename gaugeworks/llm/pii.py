"""Personal data: pattern spans, and spans added by weak supervision.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches that pass their test. Two kinds have no such
pattern and are added: credentials (``secret``, of long tokens of letters and digits) and personal numbers (``number``,
of 7 to 12 grouped digits: phone numbers without a plus, social security and account numbers). Three labelers vote on
each candidate (a pattern of its own form, a gazetteer of words before it, its context), expectation-maximisation over
the counts of the vote patterns estimates how reliable each labeler is for the kind, and the labels it gives train a
naive Bayes classifier over span features. What that finds at 0.5 or more is added; base spans stay.

The patterns use possessive repeats and look-behinds that change no match but keep the search linear in long texts,
and so are the sums that place the matches.

Defined cases: a null text counts as empty; a text without spans has the digest of the empty string; repeated rows
have the same result each; null doc_ids stay; a kind without candidates adds nothing; an empty table gives no
rows; other columns, whatever their names, are kept by ``find`` and ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, free, text_of

LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
#: What every match of the kind has, to skip texts without it.
NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": "[+][0-9]", "secret": "[0-9]", "number": "[0-9][^A-Za-z]{1,3}[0-9]"}
#: Kinds that are added, by the pattern of their candidates.
ADDED = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "number": r"(?=[(0-9])(?<![A-Za-z0-9+.@_-])(?<!\+[0-9]{1,3}[\x20().-]{0,2})\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){0,2}+(?![A-Za-z0-9@_]|[.-][0-9]|\x20[0-9])",
}
#: Words that announce a kind.
GAZETTEER = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "key", "auth", "bearer", "credential"),
    "number": ("phone", "telephone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "ssn", "security", "passport", "account", "iban", "license", "licence"),
}
BEFORE = 24
LABELERS = ("form", "gazetteer", "context")
#: Items of a block in running sums.
BLOCK_ITEMS = 64
#: Code points of the blocks in which a text is cut for redaction.
BLOCK = 4096
SPAN = "struct<start:bigint,end:bigint,hit:string,before:string,after:string>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum, the last one not doubled."""

    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")  # i-th from the right
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(hit)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, value, combine, zero: Column) -> Column:
    """Each item with ``before``, what ``combine`` makes of the values of all items before it, from ``zero`` on.

    Items are taken in blocks of BLOCK_ITEMS: a value is made of the totals of the blocks before and of the items
    before in its own block, so that the cost grows about as the number of items. (An array that grows in an
    aggregate would be copied at each step.)
    """
    add = lambda acc, x: combine(acc, value(x))

    def placed(all_: Column) -> Column:
        number = F.floor((F.size(all_) - 1) / BLOCK_ITEMS).cast("int")
        parts = F.transform(F.sequence(F.lit(0), number), lambda k: F.slice(all_, k * BLOCK_ITEMS + 1, F.lit(BLOCK_ITEMS)))
        return _with(F.transform(parts, lambda b: F.struct(b.alias("items"), F.aggregate(b, zero, add).alias("total"))), spread)

    def spread(blocks: Column) -> Column:
        def block(one: Column, k: Column) -> Column:
            base = F.aggregate(F.slice(blocks, F.lit(1), k), zero, lambda acc, x: combine(acc, x["total"]))
            return _with(F.struct(base.alias("base"), one["items"].alias("items")), within)

        return F.flatten(F.transform(blocks, block))

    def within(own: Column) -> Column:
        return F.transform(own["items"], lambda x, j: F.struct(F.aggregate(F.slice(own["items"], F.lit(1), j), own["base"], add).alias("before"), x.alias("item")))

    return _with(items, placed)


def matches(text: Column, pattern: str, keep, needs: str = "") -> Column:
    """start, end (code points), hit, before and after of the leftmost non-overlapping matches that ``keep`` accepts.

    The text is cut at the matches; a running sum over the gaps and matches gives the places.
    """

    def spans(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        n = F.size(gaps) - 1
        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), n).alias("next"))
        short = lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("n"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(BEFORE)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"))
        return F.transform(_running(F.transform(zipped, short), lambda x: (x["gap"] + x["n"]).cast("bigint"), lambda a, b: a + b, F.lit(0).cast("bigint")), span)

    def span(x: Column) -> Column:
        start = x["before"] + x["item"]["gap"]
        return F.struct(start.alias("start"), (start + x["item"]["n"]).alias("end"), *[x["item"][c].alias(c) for c in ("hit", "before", "after")])

    possible = F.regexp_like(text, F.lit(needs))
    found = F.filter(_with(F.split(text, pattern, -1), spans), keep)
    return F.when(possible & F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column, kind: str) -> Column:
    return matches(text, PATTERNS[kind], lambda m: _passes(kind, m["hit"]), NEEDS[kind])


def candidates(text: Column, kind: str) -> Column:
    return matches(text, ADDED[kind], lambda m: _possible(kind, m["hit"]), NEEDS[kind])


def _possible(kind: str, hit: Column) -> Column:
    return F.length(_digits(hit)).between(7, 12) if kind == "number" else F.lit(True)


def votes(m: Column, kind: str) -> Column:
    """1, 0 or -1 (abstains) of each labeler for a candidate."""
    hit, before = m["hit"], F.lower(m["before"])
    named = F.when(F.regexp_like(before, F.lit(rf"(?:^|[^a-z])(?:{'|'.join(GAZETTEER[kind])})[^a-z0-9]*+(?:(?:number|no|is|at|us|me)[^a-z0-9]++)*+$")), 1)
    assigned = F.regexp_like(before, F.lit("[=:]\\s*[\"']?$"))
    if kind == "secret":
        hexadecimal = F.regexp_like(hit, F.lit(r"^(?:[0-9a-f]++|[0-9A-F]++)$"))
        mixed = F.regexp_like(hit, F.lit("[A-Z]")) & F.regexp_like(hit, F.lit("[a-z]"))
        form = F.when((hexadecimal & F.length(hit).isin(32, 40, 64)) | (mixed & (F.length(hit) >= 20)), 1).when(F.contains(hit, F.lit("--")), 0).otherwise(-1)
        quoted = F.regexp_like(before, F.lit("[\"']$")) & m["after"].isin('"', "'")
        context = F.when(assigned | quoted, 1).when(F.regexp_like(before, F.lit("[a-z,.]\\s*$")), 0).otherwise(-1)
        return F.struct(form.alias("form"), named.otherwise(0).alias("gazetteer"), context.alias("context"))
    grouped = F.regexp_like(hit, F.lit(r"^(?:\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"))
    dated = F.regexp_like(hit, F.lit(r"^(?:(?:19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{2}[.-][0-9]{2}[.-](?:19|20)[0-9]{2}|[0-9]{4}[\x20-][0-9]{4})$"))
    form = F.when(grouped, 1).when(dated | F.contains(hit, F.lit("  ")), 0).otherwise(-1)
    priced = F.regexp_like(before, F.lit(r"[$\u20ac\u00a3#]\s*$")) | m["after"].isin("%", "$", "\u20ac", "/")
    context = F.when(priced, 0).when(assigned, 1).otherwise(-1)
    return F.struct(form.alias("form"), named.otherwise(0).alias("gazetteer"), context.alias("context"))


def features(m: Column, kind: str) -> Column:
    """Features of a span, each with a fixed set of values.

    The shape of a number is the lengths of its two to four groups, over 4 as 5; that of a secret is how many it has.
    """
    hit = m["hit"]
    groups = F.split(F.regexp_replace(hit, r"^\(", ""), r"[\x20().-]+")
    if kind == "secret":
        shape = F.least(F.size(groups), F.lit(5))
    else:
        shape = F.when(F.size(groups).between(2, 4), F.aggregate(groups, F.lit(0), lambda acc, g: acc * 6 + F.least(F.length(g), F.lit(5)))).otherwise(0)
    share = F.floor(4 * F.length(_digits(hit)) / F.length(hit))
    return F.struct(
        F.least(F.floor(F.length(hit) / 8), F.lit(8)).cast("int").alias("length"),
        share.cast("int").alias("digits"),
        F.regexp_like(hit, F.lit(r"^[0-9a-fA-F]++$")).cast("int").alias("hex"),
        F.regexp_like(m["before"], F.lit("[=:\"']\\s*$")).cast("int").alias("opened"),
        F.regexp_like(hit, F.lit("[_-]")).cast("int").alias("joined"),
        shape.alias("shape"),
        F.regexp_like(F.lower(m["before"]), F.lit(rf"(?:^|[^a-z])(?:{'|'.join(GAZETTEER[kind])})(?:[^a-z]|$)")).cast("int").alias("announced"),
        F.when(F.regexp_like(m["before"], F.lit(r"[$\u20ac\u00a3#]\s*$")), 2).when(F.regexp_like(m["before"], F.lit(r"[A-Za-z]\s*$")), 1).otherwise(0).alias("led"),
    )


FEATURES = ("length", "digits", "hex", "opened", "joined", "shape", "announced", "led")


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """EM over vote pattern counts: the prior, each labeler's P(1 | true), P(1 | false), and each pattern's posterior."""
    prior, rates = 0.5, [(0.8, 0.2)] * len(LABELERS)
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for pattern in counts:
            odds = math.log(prior / (1 - prior))
            for vote, (yes, no) in zip(pattern, rates, strict=True):
                odds += 0 if vote < 0 else math.log(yes / no) if vote else math.log((1 - yes) / (1 - no))
            posterior[pattern] = 1 / (1 + math.exp(-odds))
        total = sum(counts.values())
        prior = (1 + sum(n * posterior[p] for p, n in counts.items())) / (2 + total)
        rates = []
        for k in range(len(LABELERS)):
            cast = [(p[k], n, posterior[p]) for p, n in counts.items() if p[k] >= 0]
            # one pseudo-vote that a labeler is right keeps the classes from changing places
            rates.append(tuple((a + sum(v * n * w(q) for v, n, q in cast)) / (2 + sum(n * w(q) for v, n, q in cast)) for a, w in ((1.5, lambda q: q), (0.5, lambda q: 1 - q))))
    return prior, rates, posterior


def evidence(docs: DataFrame) -> DataFrame:
    """kind, v, name, value, n: how many candidates of an added kind with the votes ``v`` have each value of each
    feature; under the name '' how many there are. At most some thousand rows, whatever the texts hold."""

    def named(m: Column) -> Column:
        pairs = [F.struct(F.lit("").alias("name"), F.lit(0).alias("value")), *[F.struct(F.lit(n).alias("name"), m["f"][n].alias("value")) for n in FEATURES]]
        return F.transform(F.array(*pairs), lambda p: F.struct(m["kind"].alias("kind"), m["v"].alias("v"), p["name"].alias("name"), p["value"].alias("value")))

    every = [F.transform(candidates(text_of(), k), lambda m: F.struct(F.lit(k).alias("kind"), votes(m, k).alias("v"), features(m, k).alias("f"))) for k in ADDED]
    each = docs.select(F.explode(F.flatten(F.transform(F.concat(*every), named))).alias("p"))
    return each.groupBy("p.kind", "p.v", "p.name", "p.value").agg(F.count("*").alias("n"))


def train(docs: DataFrame) -> dict[str, dict]:
    """For each added kind with candidates: ``prior``, ``rates`` (of each labeler, see ``reliabilities``) and ``odds``,
    the naive Bayes log-odds {"prior": x, (feature, value): x}. The driver gets the rows of ``evidence``."""
    models = {}
    found = evidence(docs).collect()
    for kind in ADDED:
        rows = [(r.v, r.name, r.value, r.n) for r in found if r.kind == kind]
        if rows:
            models[kind] = _classifier(rows)
    return models


def _classifier(rows: list[tuple]) -> dict:
    counts: dict[tuple[int, ...], int] = {tuple(v): n for v, name, _, n in rows if not name}
    prior, rates, posterior = reliabilities(counts)
    true = 1 + sum(posterior[v] * n for v, n in counts.items())
    false = 1 + sum((1 - posterior[v]) * n for v, n in counts.items())
    seen: dict[tuple[str, int], list[float]] = {}
    for v, name, value, n in rows:
        if name:
            one = seen.setdefault((name, value), [0.5, 0.5])
            one[0] += posterior[tuple(v)] * n
            one[1] += (1 - posterior[tuple(v)]) * n
    odds = {"prior": math.log(true / false)} | {k: math.log((a / (true + 1)) / (b / (false + 1))) for k, (a, b) in seen.items()}
    return {"prior": prior, "rates": rates, "odds": odds}


def reliability_report(spark: SparkSession, models: dict[str, dict]) -> DataFrame:
    """kind, prior, labeler, rate_true, rate_false: how often each labeler votes for spans that are the kind, and aren't."""
    rows = [(kind, m["prior"], name, float(yes), float(no)) for kind, m in models.items() for name, (yes, no) in zip(LABELERS, m["rates"], strict=True)]
    return spark.createDataFrame(rows, "kind string, prior double, labeler string, rate_true double, rate_false double")


def added_spans(text: Column, kind: str, model: dict | None) -> Column:
    """The candidates that the classifier takes."""
    if model is None:
        return F.array().cast(f"array<{SPAN}>")

    def accepted(m):
        f, odds = features(m, kind), F.lit(model["odds"]["prior"])
        for name in FEATURES:
            known = [(v, x) for (n, v), x in ((k, x) for k, x in model["odds"].items() if k != "prior") if n == name]
            table = F.create_map(*[F.lit(y) for v, x in known for y in (v, x)])
            odds = odds + F.coalesce(F.element_at(table, f[name]), F.lit(0.0))
        return _possible(kind, m["hit"]) & (odds >= 0)

    return matches(text, ADDED[kind], accepted, NEEDS[kind])


KINDS = (*BASE, *ADDED)


def find(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with a struct ``name`` of an array of start, end, hit, before, after for every kind."""
    models = train(docs.select(F.col(text_col).alias("text")))
    text = text_of(text_col)
    own = [base_spans(text, k).alias(k) for k in BASE] + [added_spans(text, k, models.get(k)).alias(k) for k in ADDED]
    return docs.select("*", F.struct(*own).alias(name))


def _named(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of ``kinds``, by kind and start, comma-joined."""
    each = [F.transform(spans[k], lambda m: F.concat_ws(":", F.lit(k), m["start"].cast("string"), m["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def _clean(text: Column, marks: Column) -> Column:
    """The text with each of the sorted ``marks`` (start, end, mark) in place of what it spans; of overlapping ones the first counts.

    The text is cut into blocks once, and each gap is taken from the blocks it lies in.
    """

    def joined(x):
        def gap(a: Column, b: Column) -> Column:
            low = F.floor(a / BLOCK)
            some = F.slice(x["blocks"], (low + 1).cast("int"), (F.floor(F.greatest(b - 1, a) / BLOCK) - low + 1).cast("int"))
            return F.when(b > a, F.substring(F.array_join(some, ""), (a - low * BLOCK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

        tail = gap(F.array_max(F.transform(x["marks"], lambda m: m["item"]["end"])), x["n"])
        kept = F.filter(x["marks"], lambda m: m["item"]["start"] >= m["before"])
        return F.concat(F.array_join(F.transform(kept, lambda m: F.concat(gap(m["before"], m["item"]["start"]), m["item"]["mark"])), ""), tail)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    after = _running(marks, lambda m: m["end"], F.greatest, F.lit(0).cast("bigint"))
    return _with(F.struct(blocks.alias("blocks"), after.alias("marks"), F.length(text).cast("bigint").alias("n")), joined)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars``, if there, made to fit."""
    spans, clean = free(docs, "spans", "clean")

    def marked(kind: str) -> Column:
        return F.transform(F.col(spans)[kind], lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    marks = F.sort_array(F.concat(*[marked(k) for k in KINDS]))
    some = sum((F.size(F.col(spans)[k]) for k in KINDS), F.lit(0)) > 0
    found = find(docs, name=spans).select("*", F.when(some, _clean(text_of(), marks)).otherwise(F.col("text")).alias(clean))
    changed = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(F.coalesce(clean, F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.col("spans")[k]).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_named(F.col("spans"), BASE), 256).alias("base_sha256"), _named(F.col("spans"), KINDS).alias("spans"))
