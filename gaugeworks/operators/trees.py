"""Trees of groups, materials and sub-groups of any depth, from rows that name each leaf by its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import material_of
from gaugeworks.sources.writers import staged

NODE = ["grp", "material", "path"]


def tree_nodes(items: DataFrame, separator: str = "\x1f") -> DataFrame:
    """grp, material, path, depth, first, line_shifts of every node, those between a root and a leaf included.

    ``items`` have grp, material, path, line_shift, rid. A blank material is the line shift's part before its last
    underscore, or all of it; a blank path is one unnamed sub-group. ``first`` is the arrival that makes the node, and
    ``line_shifts`` are its own in order of arrival; a blank line shift makes nodes, but isn't listed.
    """
    shift = F.coalesce("line_shift", F.lit(""))
    rows = items.select(
        "grp", material_of(F.col("material"), shift).alias("material"), F.split(F.coalesce("path", F.lit("")), separator).alias("_whole"), "rid",
        F.when(shift != "", F.struct("rid", shift.alias("line_shift"))).alias("_own"),
    ).select("*", F.explode(F.sequence(F.lit(1), F.size("_whole"))).alias("depth"))
    here = rows.withColumns({"path": F.slice("_whole", F.lit(1), F.col("depth")), "_own": F.when(F.col("depth") == F.size("_whole"), F.col("_own"))})
    shifts = F.transform(F.array_sort(F.collect_list("_own")), lambda x: x["line_shift"])
    return here.groupBy(*NODE, "depth").agg(F.min("rid").alias("first"), shifts.alias("line_shifts"))


def _in_order(text: Column) -> Column:
    """A JSON array of texts that are JSON, in the order in which their nodes were made."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))), lambda x: x["text"])
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _open(head: Column, name: str, below: Column) -> Column:
    """A JSON object with one more field, which is JSON already."""
    text = F.to_json(head)
    return F.concat(text.substr(F.lit(1), F.length(text) - 1), F.lit(f',"{name}":'), below, F.lit("}"))


def nested_tree(items: DataFrame, separator: str = "\x1f") -> DataFrame:
    """grp, tree: the JSON array of a group's materials, each with its nested sub-groups and their line shifts.

    Nodes are folded into their parents level by level, from the deepest up, with one shuffle a level; the nodes are
    written once, and a level reads only its own.
    """
    nodes = staged(tree_nodes(items, separator), "tree")
    below = None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        level = level.withColumn("below", F.lit("[]")) if below is None else level.join(below, NODE, "left").fillna("[]", ["below"])
        head = F.struct(F.element_at("path", -1).alias("name"), "line_shifts")
        parent = F.slice("path", 1, depth - 1).alias("path")
        up = level.select("grp", "material", parent, "first", _open(head, "sub_groups", F.col("below")).alias("text")).groupBy(*NODE)
        below = up.agg(_in_order(F.col("text")).alias("below"), *([F.min("first").alias("first")] if depth == 1 else []))
    if below is None:
        return items.select("grp", F.lit("[]").alias("tree")).limit(0)
    text = _open(F.struct("material"), "sub_groups", F.col("below"))
    return below.select("grp", "first", text.alias("text")).groupBy("grp").agg(_in_order(F.col("text")).alias("tree"))
