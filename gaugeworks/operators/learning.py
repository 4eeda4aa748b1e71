"""A classifier's knowledge as a stored table of counts that batches of feedback are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.classifier import Model, _key, _words
from gaugeworks.sources import stored

#: What a row counts: a label, a token with a label, or a name as it is or normalised with a label. ``first`` and
#: ``last`` are the label's spelling at its first and last arrival there.
ARRIVAL = "struct<at:struct<batch:int,rid:string>,label:string>"
SCHEMA = f"kind string, token string, l string, n bigint, first {ARRIVAL}, last {ARRIVAL}"
KEY = ["kind", "token"]


def tallies(rows: DataFrame, fields: tuple[str, ...], label: str, batch: int) -> DataFrame:
    """Counts of one batch of training rows (``fields``, ``label``, rid); rows without a label don't count.

    Rows are dealt evenly before they are grouped, whatever files they lie in, and are counted by name and label first:
    what they count is exploded from the distinct ones, so that no task sorts many times the rows that it has read.
    """
    missing = [c for c in (*fields, label, "rid") if c not in rows.columns]
    if missing:
        raise ValueError(f"training rows have no column {', '.join(missing)}")
    arrival = F.struct(F.struct(F.lit(batch).alias("batch"), F.col("rid").cast("string").alias("rid")).alias("at"), F.col(label).alias("label"))
    dealt = rows.where(F.trim(label) != "").select(*fields, label, arrival.alias("arrival")).repartition("arrival.at.rid")
    total = [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")]
    names = dealt.groupBy(*fields, label).agg(F.count("*").alias("n"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))
    one = lambda kind, token: F.struct(F.lit(kind).alias("kind"), token.alias("token"))
    single = F.array(one("prior", F.lit("")), one("exact", _key(fields, False)), one("normal", _key(fields, True)))
    counted = F.concat(single, F.transform(_words(fields), lambda w: one("vote", w)))
    each = names.select(F.lower(label).alias("l"), "n", "first", "last", F.explode(counted).alias("c"))
    return each.groupBy("c.kind", "c.token", "l").agg(*total)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts are added, and the earliest and latest arrivals stand: the same whatever batches came before."""
    return old.unionByName(new).groupBy(*KEY, "l").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def start(rows: DataFrame, path: str, fields: tuple[str, ...], label: str, parts: int = stored.PARTS) -> None:
    """Store what the base rows tell, as batch 0."""
    stored.create(tallies(rows, fields, label, 0), path, KEY, parts)


def learn(rows: DataFrame, path: str, fields: tuple[str, ...], label: str, batch: int, parts: int = stored.PARTS) -> list[int]:
    """Merge a batch of feedback, numbered from 1 as it arrives, into what is stored; only parts with its keys are written.

    A batch must be merged once: its counts are added.
    """
    return stored.change(rows.sparkSession, path, tallies(rows, fields, label, batch), SCHEMA, KEY, merged, parts)


def model(spark: SparkSession, path: str, fields: tuple[str, ...], label: str, wins: str = "first") -> Model:
    """The model that all batches so far give; names are looked up by their first or last arrival."""
    table = stored.read(spark, path, SCHEMA)
    of = lambda kind: table.where(F.col("kind") == kind)
    arrival = F.min("first") if wins == "first" else F.max("last")
    exact, normal = (of(kind).groupBy(F.col("token").alias("k")).agg(arrival["label"].alias(f"_{kind}")) for kind in ("exact", "normal"))
    priors = of("prior").select("l", F.col("first.label").alias(label), F.col("n").alias("prior"))
    return Model(fields, label, priors, of("vote").select("token", "l", "n"), exact, normal)
