"""A split: children of a node, and the side or sides that each box goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.functions.sah import by_axis
from boxwood.schema import BOUNDS, CHUNKS, EXTENT, KEYS

#: What becomes of a row of a level.
LEAF, SMALL, OPEN = 0, 1, 2


def sides(mem: DataFrame, splits: DataFrame, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """mem with goes_left and goes_right: whether a box's start comes before the split's edge, and its end after; with how="left", rows of nodes without a split have nulls."""
    plane = splits.select("node", F.col("axis").alias("s_axis"), F.col("key").alias("s_key"), *also)
    low = by_axis(F.col("s_axis"), tuple(F.col(c) for c in KEYS[::2]))
    high = by_axis(F.col("s_axis"), tuple(F.col(c) for c in KEYS[1::2]))
    return mem.join(plane, "node", how).withColumns({"goes_left": low < F.col("s_key"), "goes_right": F.col("s_key") < high})


def child_extents(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """node, depth, extent, n of both children of every split node, empty ones included."""
    joined = nodes.join(splits.select("node", "axis", "t", "na", "nb"), "node")
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    both = joined.withColumn("side", side)
    columns = {}
    for a in range(3):
        low, high = EXTENT[2 * a], EXTENT[2 * a + 1]
        columns[low] = F.when((F.col("axis") == a) & (F.col("side") == 1), F.col("t")).otherwise(F.col(low))
        columns[high] = F.when((F.col("axis") == a) & (F.col("side") == 0), F.col("t")).otherwise(F.col(high))
    return both.select(
        (F.col("node") * 2 + F.col("side")).alias("node"),
        (F.col("depth") + 1).alias("depth"),
        *(columns[c].alias(c) for c in EXTENT),
        F.when(F.col("side") == 0, F.col("na")).otherwise(F.col("nb")).alias("n"),
    )


def classify(mem: DataFrame, splits: DataFrame) -> DataFrame:
    """The memberships of the children: node, tri, bounds, keys, chunks. A box across the plane is in both."""
    return sides(mem, splits).select(F.explode(_children()).alias("node"), "tri", *BOUNDS, *KEYS, *CHUNKS)


def _children() -> Column:
    left = F.when(F.col("goes_left"), F.array(F.col("node") * 2)).otherwise(F.array().cast("array<bigint>"))
    right = F.when(F.col("goes_right"), F.array(F.col("node") * 2 + 1)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(left, right)


def descend(mem: DataFrame, splits: DataFrame, finish_below: int = 0) -> DataFrame:
    """node, state, tri, bounds, keys, chunks: rows of unsplit nodes stay (LEAF), the others move to the children, which are SMALL with at most finish_below boxes, else OPEN; one join does it all."""
    joined = sides(mem, splits, "left", ("na", "nb"))
    child = lambda node, n: F.array(F.struct(node.alias("node"), F.when(F.col(n) <= finish_below, SMALL).otherwise(OPEN).alias("state")))
    none = F.array().cast("array<struct<node:bigint,state:int>>")
    to = F.concat(F.when(F.col("goes_left"), child(F.col("node") * 2, "na")).otherwise(none), F.when(F.col("goes_right"), child(F.col("node") * 2 + 1, "nb")).otherwise(none))
    to = F.when(F.col("s_key").isNull(), F.array(F.struct(F.col("node"), F.lit(LEAF).alias("state")))).otherwise(to)
    return joined.select(F.inline(to), "tri", *BOUNDS, *KEYS, *CHUNKS)
