"""Look-ups of dimensions, and what is missing from them.

Dimensions are joined without a broadcast hint: Spark broadcasts those under its size threshold and shuffles others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import normalize

ROUTE = ["material", "code", "process"]


def route_with_fallback(rows: DataFrame, routing: DataFrame) -> DataFrame:
    """process_type by material, code and normalised process name, else by code and name of any material; else ''.

    The first arrival (``rid``) of a key counts. Names of ``rows`` are normalised already; rows that have a process_type keep it.
    """
    named = routing.select("material", "code", normalize(F.col("process")).alias("process"), "process_type", "rid")
    exact = named.groupBy(*ROUTE).agg(F.min_by("process_type", "rid").alias("_exact"))
    loose = named.groupBy("code", "process").agg(F.min_by("process_type", "rid").alias("_loose"))
    found = rows.join(exact, ROUTE, "left").join(loose, ["code", "process"], "left")
    own = [F.nullif(F.col("process_type"), F.lit(""))] if "process_type" in rows.columns else []
    return found.withColumn("process_type", F.coalesce(*own, "_exact", "_loose", F.lit(""))).drop("_exact", "_loose")


def route_exact(rows: DataFrame, routing: DataFrame) -> DataFrame:
    """process_type by the whole key with names as they are; the last arrival (``rid``) counts; else ''."""
    exact = routing.groupBy(*ROUTE).agg(F.max_by("process_type", "rid").alias("process_type"))
    return rows.join(exact, ROUTE, "left").fillna("", ["process_type"])


def reason(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """reason by process and defect name, regardless of case; the first arrival (``rid``) counts; '' if there is none."""
    named = reasons.where("process <> '' and ng <> ''")
    keys = named.groupBy(F.lower("process").alias("_p"), F.lower("ng").alias("_n")).agg(F.min_by("reason", "rid").alias("reason"))
    found = rows.withColumns({"_p": F.lower("process"), "_n": F.lower("ng")}).join(keys, ["_p", "_n"], "left")
    return found.drop("_p", "_n").fillna("", ["reason"])


def reason_exact(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """reason by process and defect name as they are; the last arrival (``rid``) counts; '' if there is none."""
    keys = reasons.groupBy("process", "ng").agg(F.max_by("reason", "rid").alias("reason"))
    return rows.join(keys, ["process", "ng"], "left").fillna("", ["reason"])


def update_from(rows: DataFrame, changes: DataFrame, key: list[str], column: str) -> DataFrame:
    """``column`` replaced where ``changes`` has the key; of duplicates the largest value, and null if all are.

    Key parts are compared as texts, and null equals the empty text.
    """
    own = {f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(key)}
    new = changes.groupBy(*[c.alias(k) for k, c in own.items()]).agg(F.max(column).alias("_new"), F.lit(True).alias("_hit"))
    found = rows.withColumns(own).join(new, list(own), "left")
    return found.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*rows.columns)


def missing_keys(rows: DataFrame, dimension: DataFrame, key: list[str]) -> DataFrame:
    return rows.select(*key).distinct().join(dimension.select(*key), key, "left_anti")


def coverage(rows: DataFrame, dimension: DataFrame, key: list[str]) -> DataFrame:
    """applied_rows and missing_rows, and the number of missing keys."""
    known = dimension.select(*key).distinct().withColumn("_known", F.lit(True))
    counted = rows.groupBy(*key).count().join(known, key, "left")
    return counted.agg(
        F.sum(F.when(F.col("_known"), F.col("count")).otherwise(0)).alias("applied_rows"),
        F.sum(F.when(F.col("_known"), 0).otherwise(F.col("count"))).alias("missing_rows"),
        F.count_if(F.col("_known").isNull()).alias("missing_keys"),
    )


def with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, **measures: Column) -> DataFrame:
    """Each parent with ``children``, the number of its rows in ``children``, and what ``measures`` makes of them (null without any)."""
    counted = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("children"), *[m.alias(n) for n, m in measures.items()])
    return parents.join(counted, key, "left").fillna(0, ["children"])


def difference(rows: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows whose key isn't among the other's."""
    return rows.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def expand_groups(rows: DataFrame, members: DataFrame, key: str = "supplier") -> DataFrame:
    """A row for each group that the row belongs to; rows of no group stand for their own line_shift."""
    return rows.join(members, key, "left").withColumn("grp", F.coalesce("grp", "line_shift"))


def category(rows: DataFrame, categories: DataFrame, column: str) -> DataFrame:
    """``category`` of a code regardless of case, the last arrival (``rid``) of a code; codes without one stand for themselves."""
    known = categories.where("code <> ''").groupBy(F.lower("code").alias("_c")).agg(F.max_by("name", "rid").alias("_name"))
    found = rows.withColumn("_c", F.lower(column)).join(known, "_c", "left")
    return found.withColumn("category", F.coalesce("_name", column)).drop("_c", "_name")


def replace_on_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key isn't in ``new``, and all new rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, key: list[str], names: tuple[str, ...] = (), order: str = "rid") -> DataFrame:
    """All old rows, and of the new ones with a key that isn't there the first by ``order``.

    Key columns in ``names`` are compared normalised on both sides and written so; a new row in which one of them is
    blank is skipped.
    """
    own = {f"_k{i}": normalize(F.coalesce(c, F.lit(""))) if c in names else F.col(c) for i, c in enumerate(key)}
    keys = [c.alias(k) for k, c in own.items()]
    blank = F.array_contains(F.array(*[own[f"_k{i}"] for i, c in enumerate(key) if c in names] or [F.lit(" ")]), "")
    firsts = new.where(~blank).groupBy(*keys).agg(F.min_by(F.struct(*old.columns), order).alias("_r"))
    fresh = firsts.join(old.select(*keys), list(own), "left_anti")
    written = {c: F.col(f"_k{key.index(c)}") if c in names else F.col(f"_r.{c}") for c in old.columns}
    return old.unionByName(fresh.select(*[w.alias(c) for c, w in written.items()]))
