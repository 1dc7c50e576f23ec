"""Sweep events: a box gives a start and an end on each axis; counts run along their order (t, tri, et)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwood.operators.keys import edge_type
from boxwood.operators.ordering import running
from boxwood.schema import BOUNDS, CHUNKS, END, KEYS, START

ORDER = ("t", "tri", "et")
#: A node (of at most 31 bits) and an axis need 33 bits of a group's number.
CHUNK_BITS = 26


def create_edges(boxes: DataFrame, keys: tuple[str, ...] = ("tri",)) -> DataFrame:
    """keys, axis, et, t: six rows for each box, from one scan."""
    events = [F.struct(F.lit(axis).alias("axis"), F.lit(et).alias("et"), F.col(BOUNDS[2 * axis + et]).alias("t")) for axis in range(3) for et in (START, END)]
    return boxes.select(*keys, F.inline(F.array(*events)))


def keyed_edges(mem: DataFrame, chunked: bool = False) -> DataFrame:
    """group, key, t: the edges of boxes that have KEYS and CHUNKS. A group is an axis of a node, or a chunk of it, as one number."""
    node = F.col("node") * 3
    chunk = lambda k: F.col(CHUNKS[k]).cast("bigint") if chunked else F.lit(0).cast("bigint")
    events = [F.struct(F.shiftleft(node + k // 2, CHUNK_BITS).bitwiseOR(chunk(k)).alias("group"), F.col(KEYS[k]).alias("key"), F.col(BOUNDS[k]).alias("t")) for k in range(6)]
    return mem.select(F.inline(F.array(*events)))


def positions(edges: DataFrame) -> DataFrame:
    """edges with pos, their place (from 0) in the order of their axis."""
    return running(edges, list(ORDER), {"pos": F.lit(1)}, keys=("axis",)).withColumn("pos", F.col("pos") - 1)


def edge_positions(edges: DataFrame) -> DataFrame:
    """For each box, the places (from 0) of its six edges in the order of their axes."""
    at = lambda axis, et: F.max(F.when((F.col("axis") == axis) & (F.col("et") == et), F.col("pos")))
    return positions(edges).groupBy("tri").agg(*(at(a, e).alias(f"{'xyz'[a]}{e}") for a in range(3) for e in (START, END)))


def swept(edges: DataFrame, group: str) -> DataFrame:
    """edges with place (from 1) and starts up to the edge, itself included, among the edges of the same group."""
    along = Window.partitionBy(group).orderBy("key")
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return edges.withColumns({"place": F.row_number().over(along), "starts": F.sum(F.lit(1) - edge_type(F.col("key"))).over(upto)})


def chunk_of(t: Column, axis: Column, bounds: list[list[float]]) -> Column:
    """The number of the axis's bounds that are at most t."""
    held = F.array(*(F.array(*(F.lit(b).cast("float") for b in own)) for own in bounds))
    return F.size(F.filter(F.get(held, axis), lambda b: b <= t))


def key_bounds(boxes: DataFrame, chunks: int) -> list[list[int]]:
    """chunks - 1 approximate quantiles of the KEYS of each axis; they only set how the work is divided, also among equal t."""
    shares = F.array(*(F.lit(k / chunks) for k in range(1, chunks)))
    keys = boxes.select(F.inline(F.array(*(F.struct(F.lit(k // 2).alias("axis"), F.col(key).alias("key")) for k, key in enumerate(KEYS)))))
    by = {r["axis"]: sorted(set(r["q"])) for r in keys.groupBy("axis").agg(F.percentile_approx("key", shares, 4 * chunks).alias("q")).collect()}
    return [by.get(a, []) for a in range(3)]


def prescan(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """starts and ends of each chunk."""
    return edges.groupBy(*keys).agg(F.count_if(F.col("et") == START).alias("starts"), F.count_if(F.col("et") == END).alias("ends"))


def prescan_offsets(counts: DataFrame, keys: tuple[str, ...], chunk: str = "chunk") -> DataFrame:
    """counts with the starts and ends of all chunks before."""
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long") for c in ("starts", "ends")})
