"""Document fingerprints: a Merkle tree over sections, paragraphs and chunks of a text.

A text is cut at blank lines (two newlines) into sections, a section at newlines into paragraphs, and a paragraph after
certain letters that end a word into chunks, the leaves; all cuts lose nothing. Where chunks end depends on the
letters near them, so that cuts after an edit fall as before it. A leaf's node is the SHA-256 of its text, a
paragraph's that of its leaves' nodes, a section's that of its paragraphs' nodes, the root that of the sections'
nodes, so equal roots mean equal texts.

The fingerprint writes the tree down: the root, and the nodes of sections (the first 16 digits), of paragraphs (16) and
leaves (8) below them. Two fingerprints are compared from the top: branches with equal nodes are left out, and only
under differing ones the next level is looked at. The likeness is the part of distinct leaves that isn't in a differing
branch; it is 1 for equal texts only.

Defined cases: a null text counts as empty; empty texts are equal (likeness 1) and unlike any other (0); null doc_ids
come last in descending order, by a hash of the text; rows of one doc_id are ordered by text; an only row is its own
next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.llm.common import documents, text_of

#: Leaves have so many code points at least, and at most where no word ends fittingly.
SHORTEST, LONGEST = 24, 512
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST}}}?(?:[aenrst.,][\x20\t]|[、。]|\z)|.{{1,{LONGEST}}}"
#: Digits of the nodes that a fingerprint has below its root: sections and paragraphs, leaves.
NODE, LEAF = 16, 8
#: Bytes of text in a block of ``with_next``, and blocks at most.
BLOCK_BYTES, BLOCKS = 32 << 20, 20_000
LOWEST = -(1 << 63)


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def tree(text: Column) -> Column:
    """The fingerprint: root, ``:``, sections joined by ``;``. A section is node, ``=`` and its paragraphs joined by
    ``,``; a paragraph is node and its leaves, each after a ``.``."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.regexp_extract_all(p, F.lit(CHUNK), F.lit(0)), _sha)
        short = F.transform(leaves, lambda x: F.concat(F.lit("."), F.substring(x, 1, LEAF)))
        return F.struct(_sha(F.array_join(leaves, ".")).alias("node"), F.array_join(short, "").alias("below"))

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), paragraph)

    def node(parts: Column) -> Column:
        return _sha(F.array_join(F.transform(parts, lambda p: p["node"]), ","))

    def written(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p: F.concat(F.substring(p["node"], 1, NODE), p["below"])), ",")

    nodes = F.transform(F.transform(F.split(text, "\n\n", -1), section), lambda s: F.struct(node(s).alias("node"), written(s).alias("below")))
    # bound once by a one-row transform, so that the tree isn't computed again for each use
    root = lambda all_: F.concat(_sha(F.array_join(F.transform(all_, lambda s: s["node"]), ";")), F.lit(":"), F.array_join(F.transform(all_, lambda s: F.concat(F.substring(s["node"], 1, NODE), F.lit("="), s["below"])), ";"))
    return F.get(F.transform(F.array(nodes), root), F.lit(0))


def root_of(tree: Column) -> Column:
    return F.substring(tree, 1, 64)


def _sections(tree: Column) -> Column:
    return F.split(F.substring(tree, F.lit(66), F.length(tree)), ";", -1)


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, F.lit(NODE + 2), F.length(s)), ",", -1)))


def _leaves(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.filter(F.split(F.substring(p, F.lit(NODE + 1), F.length(p)), r"\.", -1), lambda x: x != "")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1, and 1 for equal roots only."""

    def only(x: Column, y: Column) -> Column:
        return F.struct(F.array_except(x, y).alias("a"), F.array_except(y, x).alias("b"))

    def then(pair: Column, below) -> Column:
        return F.get(F.transform(F.array(pair), lambda p: only(below(p["a"]), below(p["b"]))), F.lit(0))

    sections = only(_sections(a), _sections(b))
    leaves = then(then(sections, _paragraphs), _leaves)

    def part(both: Column) -> Column:
        gone = F.size(both["leaves"]["a"]) + F.size(both["leaves"]["b"])
        return 1 - F.greatest(gone, F.lit(1)) / F.greatest(both["n"], F.lit(1))

    def count(t: Column) -> Column:
        return F.size(F.array_distinct(_leaves(_paragraphs(_sections(t)))))

    both = F.struct(leaves.alias("leaves"), (count(a) + count(b)).alias("n"))
    return F.when(root_of(a) == root_of(b), F.lit(1.0)).otherwise(F.greatest(F.get(F.transform(F.array(both), part), F.lit(0)), F.lit(0.0)))


def edits(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, section, paragraph (from 0): places of the new fingerprints whose paragraphs the old ones don't have.

    Both have ``key`` and ``fingerprint``. Documents with equal roots are left out first, and so are equal sections
    before paragraphs are compared.
    """
    roots = old.select(key, root_of(F.col("fingerprint")).alias("root"))
    changed = new.withColumn("root", root_of(F.col("fingerprint"))).join(roots, [key, "root"], "left_anti")

    def sections(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.posexplode(_sections(F.col("fingerprint"))).alias("section", "text"))

    branches = sections(changed).join(sections(old).select(key, "text"), [key, "text"], "left_anti")
    known = sections(old).select(key, F.explode(_paragraphs(F.array("text"))).alias("node")).distinct()
    return branches.select(key, "section", F.posexplode(_paragraphs(F.array("text"))).alias("paragraph", "node")).join(known, [key, "node"], "left_anti").select(key, "section", "paragraph")


def trees(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs``."""
    return docs.select("doc_id", tree(text_of()).alias("fingerprint"))


def with_next(docs: DataFrame, **made: Column) -> DataFrame:
    """doc_id, text and the next row's text (``after``) in descending doc_id order; after the last comes the first.

    ``made`` are columns made of ``text``; each comes once from its row, and also as ``next_`` and its name from the next row.

    The ids alone give block bounds (approximate percentiles; a block has about BLOCK_BYTES of text, or less for
    parallelism) and each block's first row; a row that is first in its block is also sent to the block before, so one
    shuffle of the texts by block is enough to see every row's next. Null doc_ids are keyed far below all others by a
    hash of their text, so that they are spread over blocks too.
    """
    spark = docs.sparkSession
    mark = F.xxhash64(text_of())
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(mark, 3) + F.lit(LOWEST)))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = min(BLOCKS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BLOCK_BYTES))
    asked = [i / blocks for i in range(1, blocks)]
    bounds = sorted(set(keyed.agg(F.percentile_approx("key", asked, 10 * blocks)).first()[0] or []))
    depth = max(1, len(bounds)).bit_length()
    padded = F.lit([*bounds, *[(1 << 63) - 1] * ((1 << depth) - len(bounds))]).cast("array<bigint>")
    strides = F.lit([1 << (depth - 1 - i) for i in range(depth)])

    def step(low, stride):  # binary search for the number of bounds below the key
        return F.when(F.element_at(padded, low + stride) < F.col("key"), low + stride).otherwise(low)

    block = F.aggregate(strides, F.lit(0), step)
    firsts = sorted((r.block, r.first) for r in keyed.withColumn("block", block).groupBy("block").agg(F.max("key").alias("first")).collect())  # a row a block
    before = {b: firsts[(i + 1) % len(firsts)][0] for i, (b, _) in enumerate(firsts)}
    # by block, from 0; blocks without rows have none
    places = range(1 + max((b for b, _ in firsts), default=0))
    first_of = F.lit([dict(firsts).get(b, LOWEST) for b in places]).cast("array<bigint>")
    before_of = F.lit([before.get(b, 0) for b in places]).cast("array<int>")
    rows = keyed.select("doc_id", text_of().alias("text"), "key").withColumns(made | {"block": block})
    own = F.struct(F.col("block").alias("to"), F.lit(False).alias("extra"))
    also = F.struct(F.get(before_of, F.col("block")).alias("to"), F.lit(True).alias("extra"))
    sent = F.when(F.col("key") == F.get(first_of, F.col("block")), F.array(own, also)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", *made, "key", F.explode(sent).alias("s")).select("doc_id", "text", *made, "key", "s.to", "s.extra")
    order = Window.partitionBy("to").orderBy("extra", F.desc("key"), "text")
    nexts = {"after": "text"} | {f"next_{name}": name for name in made}
    found = dealt.withColumns({name: F.lead(of).over(order) for name, of in nexts.items()})
    return found.where("not extra").select("doc_id", "text", *made, *nexts)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's tree is built once and sent with its text, so that the row before needn't build it again
    rows = with_next(documents(spark, sf_dir), fingerprint=tree(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("after", F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    found = rows.select("doc_id", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), "fingerprint", tree(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
