"""SimHash near-dedup with deletion-variant signatures.

Fingerprints within ``distance`` bits are linked. A fingerprint is cut into ``distance // 2 + 1`` segments, so of a
linked pair one segment differs by at most one bit. Each segment is indexed once for each of its bits, with that bit
taken out (a wildcard): segments that differ by at most one bit share such a variant. Pairs meet by an equality join
on the variants and are verified in the join condition, which also keeps each pair at one variant only.

Only distinct fingerprints are joined, so copies are never expanded into pairs. Components come from alternating
large-star and small-star steps over the links, each step a written table; nothing is collected to the driver.

Defined cases: a null text counts as empty; texts without words have fingerprint zero, which links like any other;
texts of fewer words than a shingle have one shingle of all their words; null doc_ids never name a component unless
no other id is in it; repeated rows are repeated in the result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gaugeworks.llm.common import Scratch, documents, free, hold, join_groups, join_spread, omit, pick, small_batches, stage, text_of
from gaugeworks.llm.shingles import AT_ONCE, SEED, common_shingles, forget, head, jaccard, may_be_similar, parity, shingle_set

BITS = 64


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes, as a signed number."""
    ones = np.unpackbits(hashes.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str, shingle: int = 4) -> int:
    """Bits set in over half of the XXH64 values of the text's word shingles; A-Z are lower-cased, repeats count."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return simhash(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64).view(np.int64)) & (1 << BITS) - 1


def fingerprint_column(shingle: int):
    @F.pandas_udf(LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return of


def segments(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(fp, first: int, width: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def variants(fp, cuts: list[tuple[int, int]], word: int = 0) -> Column:
    """An array of one key for each bit of ``fp``: its segment without that bit; keys of other bits or words differ."""
    keys = []
    for s, (first, width) in enumerate(cuts):
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            keys.append(_part(fp, first, width).bitwiseAND(F.lit(mask)) + F.lit((word * 128 + s * width + bit + s) << 32))
    return F.array(*keys)


def is_first_meeting(variant, apart, cuts: list[tuple[int, int]]) -> Column:
    """Whether a pair counts at this variant: in its first segment with at most one differing bit, that bit (or the first)."""
    where = F.lit(-1)
    for s, (first, width) in reversed(list(enumerate(cuts))):
        part = _part(apart, first, width)
        at = F.when(part == 0, F.lit(0)).otherwise(F.log2(part.cast("double")).cast("int"))
        where = F.when(F.bit_count(part) <= 1, at + F.lit(s * width + s)).otherwise(where)
    return F.shiftrightunsigned(variant, 32).bitwiseAND(F.lit(127)) == where


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``fp`` values within ``distance`` bits, each once."""
    cuts = segments(distance)
    index = fps.select("fp", F.explode(variants(F.col("fp"), cuts)).alias("variant"))
    a, b = index.select(F.col("fp").alias("a"), "variant"), index.select(F.col("fp").alias("b"), "variant")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(apart) <= distance) & is_first_meeting(F.col("variant"), apart, cuts)
    return a.join(b.hint("merge"), "variant").where(near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, for nodes that have an edge (a, b).

    Alternating large-star and small-star steps until nothing changes, about log2 of the largest diameter rounds.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = now


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id of the component), for every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = stage(docs.select("doc_id", fingerprint_column(shingle)(text_of()).alias("fp")), "fingerprints")
    groups = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    found = components(links(groups.select("fp"), distance))
    named = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = named.groupBy("label").agg(F.min("low").alias("component_id"))
    labelled = stage(named.join(ids, "label").select("fp", "n", "component_id"), "labelled")
    return join_groups(rows, labelled, "fp", "n", rows.count()).drop("n")


#: Rows of one shingle beyond which parity sketches are compared inside the join.
CROWD = 64


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, distance: int = 4) -> DataFrame:
    """doc_id, mark, stays_id, stays: every row's near-copy group, named by the row that stays.

    Near copies have a Jaccard similarity of ``least`` or more on ``shingle``-word shingles, and a group is what such
    links connect. Candidates come in three passes, each verified by the similarity of the whole shingle sets:

    1. SimHash fingerprints of the shingle sets within ``distance`` bits, by deletion variants as in ``links``.
    2. Fingerprints alone miss about half of the pairs near 0.8, which differ in ten bits on average, so every text
       also meets the first text of each of its first shingles, in an order that puts common ones last: all pairs of
       ``least`` or more share one of these (``shingles.head``).
    3. The groups found so are contracted, and texts of different groups that still meet at a shingle are compared.

    So large groups aren't expanded into pairs. Before whole sets are joined in, parity sketches refuse most pairs that
    aren't similar, and none that is. Texts are told apart by ``mark``, a 64-bit hash; equal texts are one node. Of a
    group the row with the smallest doc_id stays (nulls last, then the smallest mark).
    """
    scratch = Scratch(docs.sparkSession, "near")
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold(forget)
        for texts in batches:
            for i in range(0, len(texts), AT_ONCE):
                yield pd.Series([shingle_set(t, shingle) for t in texts[i : i + AT_ONCE]])

    total = docs.count()
    common, counts = common_shingles(docs, sets, total)

    @F.pandas_udf("fp bigint, head array<bigint>, odd array<bigint>, size int")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold(forget)
        for texts in batches:
            for i in range(0, len(texts), AT_ONCE):
                found = (shingle_set(t, shingle) for t in texts[i : i + AT_ONCE])
                yield pd.DataFrame([(simhash(s), head(s, common, counts, least), parity(s), len(s)) for s in found], columns=["fp", "head", "odd", "size"])

    marked = docs.select("doc_id", text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    numbered = marked.select("doc_id", "mark", F.monotonically_increasing_id().alias("key"), sketches("text").alias("s"))
    every = scratch.table(numbered.select("doc_id", "mark", "key", "s.*"), "sketches")
    texts = every.groupBy("mark").agg(F.min("key").alias("key"))
    repeated = every.select("mark").distinct().count() < total
    rows = every.join(texts.select("key").hint("merge"), "key") if repeated else every
    bare = rows.select("key", "odd", "size", "mark")

    def likely(a: str, b: str) -> Column:
        return may_be_similar(F.col(f"odd{a}"), F.col(f"odd{b}"), F.col(f"size{a}"), F.col(f"size{b}"), least)

    def attach(pairs: DataFrame, table: DataFrame, side: str, n: int, *columns: str, key: str = "key") -> DataFrame:
        own = table.select(*[F.col(c).alias(side if c == key else f"{c}_{side[-1]}") for c in (key, *columns)])
        return join_spread(pairs, own, side, f"{side[:-1]}{'b' if side[-1] == 'a' else 'a'}", n)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of keys of which the whole shingle sets are similar."""
        pairs = scratch.table(pairs.distinct(), "pairs")
        n = pairs.count()
        both = attach(attach(pairs, bare, "a", n, "odd", "size", "mark"), bare, "b", n, "odd", "size", "mark")
        possible = scratch.table(both.where(likely("_a", "_b")).select("a", "b", "mark_a", "mark_b"), "possible")
        scratch.drop(pairs)
        needed = scratch.table(possible.select(F.explode(F.array("mark_a", "mark_b")).alias("mark")).distinct(), "needed")
        chosen = pick(marked.select("mark", "text"), needed, ["mark"])
        whole = chosen.dropDuplicates(["mark"]) if repeated else chosen
        whole = scratch.table(whole.select("mark", sets("text").alias("items")), "shingles")
        n = possible.count()
        both = attach(attach(possible, whole, "mark_a", n, "items", key="mark"), whole, "mark_b", n, "items", key="mark")
        found = scratch.table(both.where(jaccard(F.col("items_a"), F.col("items_b")) >= least).select("a", "b"), "links")
        scratch.drop(possible, needed, whole)
        return found

    prints = rows.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n"))
    prints = scratch.table(prints, "prints")
    firsts = prints.select("fp", "low")
    near = links(firsts.select("fp"), distance)
    near = near.join(firsts.withColumnsRenamed({"fp": "a", "low": "x"}), "a").join(firsts.withColumnsRenamed({"fp": "b", "low": "y"}), "b")
    equal = join_groups(rows.select("key", "fp"), prints.where("n > 1"), "fp", "n", total).where("key <> low")
    found = verified(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(equal.select(F.col("low").alias("a"), F.col("key").alias("b"))))

    places = rows.select("key", "size", F.posexplode("head").alias("place", "item"))
    shared = scratch.table(meeting(scratch, places, "key"), "shared")
    leads = shared.select(F.col("low").alias("a"), F.col("key").alias("b")).where("a <> b").distinct()
    stars = verified(leads.join(found.hint("merge"), ["a", "b"], "left_anti"))
    found = found.unionByName(stars)

    named = shared.drop("low", "n").join(components(found).withColumnRenamed("node", "key").hint("merge"), "key", "left")
    named = scratch.table(named.withColumn("label", F.coalesce("label", "key")), "named")
    meetings = scratch.table(meeting(scratch, named, "label").drop("low"), "meetings")
    scratch.drop(shared, named)

    def pairs_of(at: DataFrame, *more: str, fits: Column) -> DataFrame:
        """Pairs (a, b) of rows of different labels that meet at a shingle, have enough left there, and pass ``fits``."""
        a, b = (at.select("item", *[F.col(c).alias(f"{c}_{side}") for c in ("key", "label", "size", "place", *more)]) for side in "ab")
        left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
        enough = (F.col("label_a") < F.col("label_b")) & (left >= (F.col("size_a") + F.col("size_b")) * F.lit(least / (1 + least)) - F.lit(1e-6))
        return a.join(b.hint("merge"), "item").where(enough & fits).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))

    crowd = meetings.where(F.col("n") > CROWD).join(bare.select("key", "odd"), "key")
    rest = verified(pairs_of(meetings.where(F.col("n") <= CROWD), fits=F.lit(True)).unionByName(pairs_of(crowd, "odd", fits=likely("_a", "_b"))))
    scratch.drop(meetings)
    names = components(found.unionByName(rest)).withColumnRenamed("node", "key")
    texts = rows.select("key", "mark").join(names, "key", "left").select("mark", F.coalesce("label", "key").alias("label"))
    members = every.select("doc_id", "mark")
    if repeated:
        members = join_groups(members, texts.join(members.groupBy("mark").agg(F.count("*").alias("n")), "mark"), "mark", "n", total).drop("n")
    else:
        members = every.select("doc_id", "mark", "key").join(names, "key", "left").select("doc_id", "mark", F.coalesce("label", "key").alias("label"))
    members = scratch.table(members, "members")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark"))
    chosen = members.groupBy("label").agg(best.alias("best"), F.count("*").alias("n"))
    named = join_groups(members, chosen, "label", "n", total)
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark"))
    return named.select("doc_id", "mark", F.col("best.doc_id").alias("stays_id"), stays.alias("stays"))


def meeting(scratch: Scratch, places: DataFrame, name: str) -> DataFrame:
    """The rows of ``places`` at items where ``name`` has several values, with its smallest as ``low`` and the number ``n`` of rows; no task has all rows of a hot item."""
    met = places.groupBy("item").agg(F.min(name).alias("low"), F.max(name).alias("_high"), F.count("*").alias("n")).where("low < _high")
    met = scratch.table(met.drop("_high"), "items")
    return join_groups(places, met, "item", "n", met.agg(F.sum("n")).first()[0] or 0)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay of their near-copy groups, with all their columns (``similar_groups``).

    Rows with equal doc_id and text are one document and share its fate.
    """
    scratch, (one, mark) = Scratch(docs.sparkSession, "copies"), free(docs, "near_id", "near_mark")
    gone = scratch.table(similar_groups(docs, **options).where("not stays").select(F.col("doc_id").alias(one), F.col("mark").alias(mark)).distinct(), "gone")
    own = docs.select("*", F.col("doc_id").alias(one), F.xxhash64(text_of()).alias(mark))
    return omit(own, gone, [one, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
