"""Convex hulls of groups of points, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directions, counter-clockwise, in whose farthest points most others are enclosed.
DIRECTIONS = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def _turn(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """The two products whose difference is over zero where a, b, c turn to the left."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]), (b["y"] - a["y"]) * (c["x"] - a["x"])


def without_inner(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (``group``, x, y) less those well inside the polygon of their group's farthest points in eight directions."""
    farthest = [F.max_by(F.struct("x", "y"), F.col("x") * dx + F.col("y") * dy) for dx, dy in DIRECTIONS]
    edges = rows.groupBy(group).agg(F.array(*farthest).alias("_e"))
    pairs = F.zip_with("_e", F.concat(F.slice("_e", 2, len(DIRECTIONS) - 1), F.slice("_e", 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def left_of(e: Column) -> Column:
        """Whether the point is to the left of an edge by more than what rounding may do."""
        a, b = _turn(e["p"], e["q"], F.struct("x", "y"))
        return a - b > 1e-9 * (F.abs(a) + F.abs(b))

    sides = F.filter(pairs, lambda e: e["p"] != e["q"])
    inside = (F.size(sides) > 2) & F.forall(sides, left_of)
    return rows.join(edges, group).where(~inside).select(group, "x", "y")


def _chain(points: Column) -> Column:
    """The points of a sorted array that keep turning left: each new one ends those behind which it doesn't.

    A chain turns left all along, so those that a point ends are its last ones, and the others can be counted.
    """
    def add(kept: Column, p: Column) -> Column:
        turns = F.filter(F.sequence(F.lit(2), F.size(kept)), lambda i: _left(F.get(kept, i - 2), F.get(kept, i - 1), p))
        stay = F.when(F.size(kept) < 2, F.size(kept)).otherwise(F.size(turns) + 1)
        return F.concat(F.slice(kept, F.lit(1), stay), F.array(p))

    return F.aggregate(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1), add)


def _left(a: Column, b: Column, c: Column) -> Column:
    one, two = _turn(a, b, c)
    return one > two


def _corners(points: Column) -> Column:
    """Corners of an array of distinct sorted points, counter-clockwise from the leftmost; fewer than three are all corners."""
    lower, upper = _chain(points), _chain(F.reverse(points))
    short = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    return F.when(F.size(points) < 3, points).otherwise(F.concat(short(lower), short(upper)))


def convex_hull(rows: DataFrame, group: str, salts: int = 64) -> DataFrame:
    """group, corner, x, y: corners of the hull of each group's points (x, y), which are rounded to eight places.

    Only the lowest and highest y of each x can be corners, and of these only points that aren't inside the polygon of
    the eight farthest ones. What is left is dealt over ``salts`` parts, and the hull of the parts' corners is the
    group's. Points without both numbers are left out.
    """
    points = rows.select(group, F.round("x", 8).alias("x"), F.round("y", 8).alias("y")).dropna(subset=["x", "y"])
    ends = points.groupBy(group, "x").agg(F.min("y").alias("_low"), F.max("y").alias("_high")).select(group, "x", F.explode(F.array_distinct(F.array("_low", "_high"))).alias("y"))
    outer = without_inner(ends, group).withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts)))
    sorted_ = F.array_sort(F.collect_list(F.struct("x", "y")))
    parts = outer.groupBy(group, "_salt").agg(sorted_.alias("_p")).select(group, F.explode(_corners(F.col("_p"))).alias("_c")).select(group, "_c.x", "_c.y")
    whole = parts.groupBy(group).agg(sorted_.alias("_p"))
    return whole.select(group, F.posexplode(_corners(F.col("_p"))).alias("corner", "_c")).select(group, "corner", "_c.x", "_c.y")
