"""Labels for names: look-ups of what was learned, rules, and a vote of the names' tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.text import classified, compared, tokens


@dataclass(frozen=True)
class Model:
    """What training rows tell: counts of labels and of tokens with labels, and look-ups of names as they are and normalised."""

    fields: tuple[str, ...]
    label: str
    priors: DataFrame
    votes: DataFrame
    exact: DataFrame
    normal: DataFrame


def _key(fields: tuple[str, ...], normal: bool) -> Column:
    one = classified if normal else (lambda c: F.lower(compared(c)))
    return F.concat_ws("\t", *[one(F.col(f)) for f in fields])


def _words(fields: tuple[str, ...]) -> Column:
    return tokens(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def train(rows: DataFrame, fields: tuple[str, ...], label: str, wins: str = "first") -> Model:
    """Learn ``label`` from the names in ``fields``; of names that come twice the first or last arrival (``rid``) is looked up.

    Labels are the same regardless of case, and written as they first arrived.
    """
    pick = F.min_by if wins == "first" else F.max_by
    folded = F.lower(label).alias("l")
    priors = rows.groupBy(folded).agg(F.min_by(label, "rid").alias(label), F.count("*").alias("prior"))
    votes = rows.select(folded, F.explode(_words(fields)).alias("token")).groupBy("token", "l").agg(F.count("*").alias("n"))
    exact, normal = (rows.groupBy(_key(fields, n).alias("k")).agg(pick(label, "rid").alias(f"_{name}")) for n, name in ((False, "exact"), (True, "normal")))
    return Model(fields, label, priors, votes, exact, normal)


def retrain(base: DataFrame, feedback: DataFrame, fields: tuple[str, ...], label: str, wins: str = "first") -> Model:
    """Learn from base rows and corrected ones, which arrive after them; feedback without a needed column is an error."""
    missing = [c for c in (*fields, label, "rid") if c not in feedback.columns]
    if missing:
        raise ValueError(f"feedback has no column {', '.join(missing)}")
    columns = [*fields, label]
    both = base.select(*columns, F.struct(F.lit(0).alias("part"), F.col("rid").cast("string").alias("rid")).alias("rid"))
    later = feedback.where(F.trim(label) != "").select(*columns, F.struct(F.lit(1).alias("part"), F.col("rid").cast("string").alias("rid")).alias("rid"))
    return train(both.unionByName(later), fields, label, wins)


def by_keywords(field: str) -> Column:
    """label and confidence that a process name's words give, or null."""
    words = tokens(F.col(field))
    one = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
    return F.when(F.array_contains(words, "VISUAL"), one("VISUAL", 0.99)).when(F.array_contains(words, "TEST"), one("FUNCTION", 0.97)).when(F.array_contains(words, "SUB"), one("SUB", 0.96))


def predict(names: DataFrame, model: Model, rule: Column | None = None, least: float = 0.55, default: tuple[str, float] = ("", 0.40)) -> DataFrame:
    """The distinct names with ``label``, ``confidence`` and ``source``: EXACT 1.00, NORMALIZED 0.95, RULE, or ML.

    The vote gives every label its count and twice its count with each token of the name; confidence is the winner's
    part of all, between ``least`` and 0.99, and ties go to the smallest label. Without any label the default stands.
    """
    fields, label = model.fields, model.label
    rows = names.select(*fields).distinct().withColumns({"_e": _key(fields, False), "_n": _key(fields, True)})
    rule = F.lit(None).cast("struct<label:string,confidence:double>") if rule is None else rule
    known = rows.join(model.exact.withColumnRenamed("k", "_e"), "_e", "left").join(model.normal.withColumnRenamed("k", "_n"), "_n", "left").withColumn("_rule", rule)
    voting = known.where(F.coalesce("_exact", "_normal", F.col("_rule.label")).isNull()).select("_n").distinct()
    # names with equal normal form have equal tokens
    cast = voting.select("_n", F.explode(tokens(F.regexp_replace("_n", "\t", " "))).alias("token")).join(model.votes, "token").groupBy("_n", "l").agg(F.sum("n").alias("n"))
    every = model.priors.agg(F.sum("prior").alias("_all"), F.min(F.struct((-F.col("prior")).alias("s"), "l", F.col(label).alias("label"))).alias("_most"))
    scored = cast.join(model.priors, "l").groupBy("_n").agg(
        F.sum("n").alias("_votes"), F.min(F.struct((-(F.col("prior") + 2 * F.col("n"))).alias("s"), "l", F.col(label).alias("label"))).alias("_voted")
    )
    found = known.join(scored, "_n", "left").crossJoin(F.broadcast(every))  # one row
    best = F.least("_voted", "_most")
    share = -best["s"] / (F.col("_all") + 2 * F.coalesce("_votes", F.lit(0)))
    voted = F.struct(F.coalesce(best["label"], F.lit(default[0])).alias("label"), F.when(best.isNull(), F.lit(default[1])).otherwise(F.least(F.greatest(share, F.lit(least)), F.lit(0.99))).alias("confidence"), F.lit("ML").alias("source"))
    one = lambda c, confidence, source: F.struct(F.col(c).alias("label"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))
    ruled = F.struct(F.col("_rule.label").alias("label"), F.col("_rule.confidence").alias("confidence"), F.lit("RULE").alias("source"))
    stage = F.when(F.col("_exact").isNotNull(), one("_exact", 1.0, "EXACT")).when(F.col("_normal").isNotNull(), one("_normal", 0.95, "NORMALIZED")).when(F.col("_rule").isNotNull(), ruled).otherwise(voted)
    return found.select(*fields, stage.alias("_p")).select(*fields, F.col("_p.label").alias(label), "_p.confidence", "_p.source")


def looked_up(names: DataFrame, model: Model) -> DataFrame:
    """Names that the look-ups know, with their label."""
    rows = names.select(*model.fields).distinct().withColumn("_e", _key(model.fields, False))
    return rows.join(model.exact.withColumnRenamed("k", "_e"), "_e").select(*model.fields, F.col("_exact").alias(model.label))


def category_index(rows: DataFrame, label: str, order: str) -> DataFrame:
    """label, place: labels regardless of case in the order in which they first appear, from 0; one row a label is ranked."""
    firsts = rows.groupBy(F.lower(label).alias("_l")).agg(F.min_by(label, order).alias(label), F.min(order).alias("_at"))
    return firsts.select(label, (F.row_number().over(Window.orderBy("_at", "_l")) - 1).alias("place"))
