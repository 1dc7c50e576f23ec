"""Whole trees: level by level as Spark jobs, and below a size in one task for each node.

The order of edges is made into one number for each edge before the first
level, and carried down. A level prices every edge of the open nodes, takes each
node's best plane, and moves the boxes down with one join; its rows are
written to the shared folder, which cuts the lineage, and deleted once the next
level is there. Nodes with no more boxes than ``finish_below`` wait and are
finished by ``finish`` in one job at the end, packed into tasks of even
work; that bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwood.functions.sah import Costs
from boxwood.operators.edges import key_bounds
from boxwood.operators.keys import numbered, with_keys
from boxwood.operators.ordering import running
from boxwood.operators.planes import SPLIT, best_planes, edge_costs, named
from boxwood.operators.split import LEAF, OPEN, SMALL, child_extents, descend
from boxwood.schema import BOUNDS, BOXES, CHUNKS, DEPTH, EXTENT, KEYS
from boxwood.storage import released, written
from boxwood.timings import Timings

NODES = "node bigint, depth int, " + ", ".join(f"{c} float" for c in EXTENT) + ", n bigint"
SPLITS = "node bigint, axis int, t float, tri bigint, et int, na bigint, nb bigint, sah float"
MAX_DEPTH = 30
#: Edges of a node along an axis that are swept as one group; beyond, an axis is divided into chunks of about as many, but into no more than four for each shuffle partition.
SWEEP = 1 << 15
#: Strategies of a build: from the number of boxes below which a subtree may be finished in one task, the number that is used.
BUILDERS: dict[str, Callable[[int], int]] = {"hybrid": lambda below: below, "levels": lambda below: 0, "tasks": lambda below: 1 << 62}


@dataclass
class Tree:
    """nodes: node, depth, extent, n, is_leaf. splits: SPLITS. leaves: node, tri. A node's children are 2 * node and 2 * node + 1."""

    nodes: DataFrame
    splits: DataFrame
    leaves: DataFrame
    max_depth: int
    timings: Timings


def normalized(boxes: DataFrame) -> DataFrame:
    """tri and bounds as float32, with -0.0 made 0.0; rows with a null are refused."""
    cols = [(F.col(c).cast("float") + F.lit(0.0).cast("float")).alias(c) for c in BOUNDS]
    out = boxes.select(F.col("tri").cast("bigint").alias("tri"), *cols)
    anything = F.lit(False)
    for c in ("tri", *BOUNDS):
        anything = anything | F.col(c).isNull()
    return out.withColumn("tri", F.when(anything, F.raise_error(F.lit("a box has a null"))).otherwise(F.col("tri")))


def mesh_extent(boxes: DataFrame) -> DataFrame:
    """The union of all boxes: one row."""
    low = {c: F.min(b) for c, b in zip(EXTENT[::2], BOUNDS[::2], strict=True)}
    high = {c: F.max(b) for c, b in zip(EXTENT[1::2], BOUNDS[1::2], strict=True)}
    both = low | high
    return boxes.agg(*(both[c].alias(c) for c in EXTENT))


def root_node(boxes: DataFrame) -> DataFrame:
    return _root(boxes).select("node", "depth", *EXTENT, "n")


def _root(boxes: DataFrame) -> DataFrame:
    """The root, and the smallest and largest id."""
    low = {c: F.min(b) for c, b in zip(EXTENT[::2], BOUNDS[::2], strict=True)}
    high = {c: F.max(b) for c, b in zip(EXTENT[1::2], BOUNDS[1::2], strict=True)}
    both = low | high
    return boxes.agg(*(both[c].alias(c) for c in EXTENT), F.count("*").alias("n"), F.min("tri").alias("first"), F.max("tri").alias("last")).select(F.lit(1).cast("bigint").alias("node"), F.lit(0).alias("depth"), *EXTENT, "n", "first", "last")


def _finisher(max_depth: int, costs: Costs):
    kinds = [("node", pa.int64()), ("depth", pa.int32())] + [(c, pa.float32()) for c in EXTENT] + [("n", pa.int64()), ("axis", pa.int32()), ("t", pa.float32()), ("tri", pa.int64()), ("et", pa.int32()), ("na", pa.int64()), ("nb", pa.int64()), ("sah", pa.float32()), ("row", pa.string())]
    schema = pa.schema(kinds)

    def table(row: str, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        arrays = [pa.array([row] * n, pa.string()) if name == "row" else pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in kinds]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def subtree(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(group)
        get = lambda c: rows.column(c).to_numpy()
        extent = np.array([rows.column(c)[0].as_py() for c in EXTENT], dtype=np.float32)
        done = finish_rows(int(get("node")[0]), int(get("depth")[0]), extent, get("tri"), np.stack([get(c) for c in BOUNDS], axis=1))
        if done.nodes:
            node, depth, extents, n = zip(*done.nodes, strict=True)
            yield table("node", node=node, depth=depth, n=n, **{c: np.array([e[i] for e in extents]) for i, c in enumerate(EXTENT)})
        if done.splits:
            yield table("split", **dict(zip(("node", "axis", "t", "tri", "et", "na", "nb", "sah"), zip(*done.splits, strict=True), strict=True)))
        for node, tri in done.leaves:
            yield table("leaf", node=np.full(len(tri), node), tri=tri)

    def finish_rows(node, depth, extent, tri, bounds):
        from boxwood.plans.finish import finish

        return finish(node, depth, extent, tri, bounds, max_depth, costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by node; one node's boxes are held at a time."""
        at, held = None, []
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            edges = [0, *(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if at is not None and nodes[a] != at:
                    yield from subtree(held)
                    held = []
                at = nodes[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from subtree(held)

    return run, ", ".join(f"{n} {'string' if n == 'row' else {'int64': 'bigint', 'int32': 'int', 'float': 'float'}[str(k)]}" for n, k in kinds)


def chunk_bounds(boxes: DataFrame, n: int) -> list[list[int]] | None:
    """Keys at which an axis is divided for all levels of a build of n boxes; None if it isn't."""
    chunks = min(-(-2 * n // SWEEP), 4 * int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return key_bounds(with_keys(boxes, "number"), chunks) if chunks > 1 else None


def build(boxes: DataFrame, max_depth: int = DEPTH, costs: Costs = Costs(), finish_below: int = 262_144, superfluous_prescans: bool = False, builder: str = "hybrid") -> Tree:
    """The greedy tree over boxes (tri, bounds).

    builder is one of BUILDERS: "levels" builds level by level to the end, "tasks"
    the whole tree in one task, "hybrid" goes by finish_below; all give the
    same tree. superfluous_prescans is accepted and has no effect. An empty table
    gives a root without boxes; ids need not be contiguous, but unique.
    """
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth is 1 to {MAX_DEPTH}")
    if builder not in BUILDERS:
        raise ValueError(f"builder is one of {', '.join(BUILDERS)}")
    spark, below = boxes.sparkSession, BUILDERS[builder](finish_below)
    clock = Timings(spark)
    with clock.phase("init_extent"):
        loaded = written(normalized(boxes))
        top = written(_root(loaded))
        nodes, root = top.select("node", "depth", *EXTENT, "n"), top.first()
        n = most = root["n"]
        own, renumbered = numbered(loaded, n, root["first"] or 0, root["last"] or 0)
        bounds = chunk_bounds(own, n) if n > below else None
        mem = written(with_keys(own, "number", bounds).select(F.lit(1).cast("bigint").alias("node"), "tri", "number", *BOUNDS, *KEYS, *CHUNKS)) if n > below else loaded.withColumn("node", F.lit(1).cast("bigint"))
    if n > below and not renumbered:
        released(loaded)
    ids = own.select("number", "tri") if renumbered else None
    all_nodes, all_splits, all_leaves, waiting, finished, read = [], [], [], [], [], None
    if not n:
        empty = spark.createDataFrame([], "node bigint, tri bigint")
        return Tree(nodes.withColumn("is_leaf", F.lit(True)), spark.createDataFrame([], SPLITS), empty, max_depth, clock)
    if n <= below:
        waiting.append((mem, nodes))
        finished.append((loaded, ""))
    level = 0
    while level < max_depth and most > below:
        last = level + 1 == max_depth
        below = 0 if last else below  # nothing of the last level is split any more, so nothing waits
        with clock.phase("findBestPlane", level):
            splits = written(best_planes(edge_costs(mem, nodes, costs, bounds is not None and 2 * most > SWEEP, cheapest=True), costs))
        with clock.phase("newGen", level):
            children = written(child_extents(nodes, splits))
            most, small = children.agg(F.coalesce(F.max("n"), F.lit(0)), F.count_if((F.col("n") > 0) & (F.col("n") <= below))).first()
        with clock.phase("classifyTriangles", level):
            moved = descend(mem, splits, below)
            moved = written(moved.select("node", "state", "tri") if last else moved, by="state")
        if read is None:
            released(mem)
        else:
            released(read, f"state={OPEN}")
        all_nodes += [nodes, children.filter("n = 0")]
        all_splits.append(splits)
        all_leaves.append(moved.filter(F.col("state") == LEAF).select("node", "tri"))
        if small:
            finished.append((moved, f"state={SMALL}"))
            waiting.append((moved.filter(F.col("state") == SMALL), children.filter((F.col("n") > 0) & (F.col("n") <= below))))
        read, mem, nodes = moved, moved.filter(F.col("state") == OPEN).drop("state"), children.filter((F.col("n") > below) & (F.col("n") > 0))
        level += 1
    if most > below:
        all_nodes.append(nodes)
        all_leaves.append(mem.select("node", "tri"))
    splits = named(_union(all_splits)) if all_splits else None
    if ids is not None and splits is not None:
        splits = splits.withColumnRenamed("tri", "number").join(ids, "number")
    every, cuts = [*all_nodes], [splits.select(*SPLIT)] if splits is not None else []
    if waiting:
        with clock.phase("finish", level):
            rows = _finished(_union([m.select("node", "tri", *BOUNDS) for m, _ in waiting]), _union([x for _, x in waiting]), max_depth, costs)
        _collect(rows, every, cuts, all_leaves)
        for table, part in finished:
            released(table, part)
    with clock.phase("fill"):
        splits = _union(cuts) if cuts else spark.createDataFrame([], SPLITS)
        split_ids = splits.select("node", F.lit(False).alias("_s"))
        nodes = _union(every).join(split_ids, "node", "left").withColumn("is_leaf", F.coalesce("_s", F.lit(True))).drop("_s")
        leaves = _union(all_leaves)
    return Tree(nodes.select("node", "depth", *EXTENT, "n", "is_leaf"), splits.select(*SPLIT), leaves.select("node", "tri"), max_depth, clock)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed_subtrees(nodes: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """nodes with the task that finishes each, and the number of tasks, at most ``tasks``.

    A subtree of n boxes is n log n of work. In falling order of work, the
    running sum says which task a subtree belongs to; there are as few tasks as
    keep the largest subtree no larger than an even share.
    """
    work = F.ceil(F.col("n") * F.log2(F.col("n") + 1) + 1)
    rows = running(nodes.withColumn("_work", work), ["_work desc", "node"], {"_upto": F.col("_work")})
    total, largest = nodes.agg(F.sum(work), F.max(work)).first()
    count = max(1, min(tasks, int(total // largest)))
    middle = F.col("_upto") - F.col("_work") / 2
    return rows.withColumn("task", F.least(F.floor(middle * count / total), F.lit(count - 1)).cast("int")).drop("_work", "_upto"), count


def _finished(rows: DataFrame, nodes: DataFrame, max_depth: int, costs: Costs) -> DataFrame:
    run, schema = _finisher(max_depth, costs)
    tasks, n = packed_subtrees(nodes, 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.join(tasks, "node").repartitionById(n, F.col("task")).sortWithinPartitions("node")
    return written(dealt.select("node", "depth", *EXTENT, "tri", *BOUNDS).mapInArrow(run, schema))


def _collect(rows: DataFrame, nodes: list[DataFrame], splits: list[DataFrame], leaves: list[DataFrame]) -> None:
    nodes.append(rows.filter("row = 'node'").select("node", "depth", *EXTENT, "n"))
    splits.append(rows.filter("row = 'split'").select(*SPLIT))
    leaves.append(rows.filter("row = 'leaf'").select("node", "tri"))


__all__ = ["BOXES", "NODES", "Tree", "build", "mesh_extent", "normalized", "root_node"]
