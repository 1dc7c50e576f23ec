"""Trees as tables for output, and as text, packed binary and GraphViz files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.operators.ordering import running
from boxwood.plans.tree import Tree
from boxwood.schema import EXTENT
from boxwood.sources.ranges import write_ranges
from boxwood.storage import released, written


def preorder_key(max_depth: int) -> Column:
    """Sorts nodes (with depth) left first, parents before children: the id, shifted to the deepest level, then the depth."""
    return F.expr(f"shiftleft(node, {max_depth} - depth)")


def _lists(tree: Tree) -> DataFrame:
    """node, depth, ids of every leaf that holds a box."""
    lists = tree.leaves.groupBy("node").agg(F.sort_array(F.collect_list("tri")).alias("ids"))
    return tree.nodes.filter("is_leaf").select("node", "depth").join(lists, "node")


def leaf_lists(tree: Tree) -> DataFrame:
    return _lists(tree).select("node", "ids")


def tree_text(tree: Tree) -> DataFrame:
    """ord (from 0), line: the ascending ids of each leaf that isn't empty, a space after each, leaves in preorder."""
    lists = _lists(tree)
    places = running(tree.nodes.filter("is_leaf and n > 0").select("node", "depth", preorder_key(tree.max_depth).alias("_key")), ["_key", "depth"], {"ord": F.lit(1)})
    rows = lists.join(places.select("node", (F.col("ord") - 1).alias("ord")), "node")
    return rows.select("ord", F.concat_ws("", F.transform("ids", lambda i: F.concat(i.cast("string"), F.lit(" ")))).alias("line"))


def _numbered(tree: Tree) -> DataFrame:
    """All nodes with preorder rank among split nodes, index in the packed tree, and their own number of items."""
    split = F.when(~F.col("is_leaf"), F.lit(1)).otherwise(F.lit(0))
    size = F.when(F.col("is_leaf"), F.col("n")).otherwise(F.lit(0))
    rows = running(tree.nodes.withColumn("_key", preorder_key(tree.max_depth)), ["_key", "depth"], {"rank": split, "offset": size}).withColumn("offset", F.col("offset") - size)
    # A split node's children stand next to each other, in the order in which split nodes are met.
    parents = rows.filter("not is_leaf").select(F.col("node").alias("parent"), (F.col("rank") * 2 - 1).alias("first"))
    placed = rows.withColumn("parent", F.expr("shiftright(node, 1)")).join(parents, "parent", "left")
    return placed.withColumn("idx", F.when(F.col("node") == 1, F.lit(0)).otherwise(F.col("first") + F.col("node") % 2).cast("bigint"))


def manta_nodes(tree: Tree) -> DataFrame:
    """idx, is_leaf, plane_dim, plane_pos, num_prims, child_idx: a leaf points to its first item, a split node to its left child."""
    planes = tree.splits.select("node", "axis", "t")
    rows = _numbered(tree).join(planes, "node", "left")
    return rows.select(
        "idx",
        "is_leaf",
        F.coalesce("axis", F.lit(0)).cast("int").alias("plane_dim"),
        "t",
        F.when(F.col("is_leaf"), F.col("n")).otherwise(F.lit(0)).cast("int").alias("num_prims"),
        F.when(F.col("is_leaf"), F.col("offset")).otherwise(F.col("rank") * 2 - 1).cast("bigint").alias("child_idx"),
    ).withColumnRenamed("t", "plane_pos")


def manta_items(tree: Tree) -> DataFrame:
    """pos (from 0), tri: the items of all leaves in preorder, ascending within a leaf."""
    first = _numbered(tree).filter("is_leaf").select("node", "offset")
    items = _lists(tree).join(first, "node").select("offset", F.posexplode("ids").alias("i", "tri"))
    return items.select((F.col("offset") + F.col("i")).cast("bigint").alias("pos"), "tri")


def tree_graph_edges(tree: Tree) -> DataFrame:
    """parent, child, label ("level: count") of every node but the root."""
    return tree.nodes.filter("node > 1").select(F.expr("shiftright(node, 1)").alias("parent"), F.col("node").alias("child"), F.concat(F.col("depth").cast("string"), F.lit(": "), F.col("n").cast("string")).alias("label"))


def tree_path_counts(tree: Tree) -> DataFrame:
    """node, n, path_n: the boxes of the node and of all nodes above it, summed."""
    below = tree.nodes.select("node", "n", F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("up"))
    above = tree.nodes.select(F.col("node").alias("above"), F.col("n").alias("above_n"))
    joined = below.withColumn("above", F.expr("shiftright(node, up)")).join(above, "above")
    return joined.groupBy("node", "n").agg(F.sum("above_n").alias("path_n"))


def split_trace(tree: Tree) -> DataFrame:
    """level, node, axis, side, tri, na, nb, t, sah of all splits."""
    level = tree.nodes.select("node", F.col("depth").alias("level"))
    return tree.splits.join(level, "node").select("level", "node", F.element_at(F.array(*map(F.lit, "xyz")), F.col("axis") + 1).alias("axis"), F.when(F.col("et") == 0, "STR").otherwise("END").alias("edge"), "t", "tri", "na", "nb", "sah")


def format_box(extent: tuple[str, ...] = EXTENT) -> Column:
    """A box as text: [low,high]x[low,high]x[low,high]."""
    side = lambda a, b: F.concat(F.lit("["), F.col(a).cast("string"), F.lit(","), F.col(b).cast("string"), F.lit("]"))
    return F.concat_ws("x", *(side(a, b) for a, b in zip(extent[::2], extent[1::2], strict=True)))


def _write_lines(rows: DataFrame, order: list[str], path: str, before: bytes = b"", after: bytes = b"") -> None:
    """Column line of rows, in an order, each with a line end: running sums of the lengths say where each goes."""
    data = rows.withColumn("data", F.encode(F.concat("line", F.lit("\n")), "utf-8"))
    placed = written(running(data, order, {"_end": F.octet_length("data")}).withColumn("at", F.col("_end") - F.octet_length("data") + len(before)).select("at", "data"))
    end = placed.agg(F.coalesce(F.max(F.col("at") + F.octet_length("data")), F.lit(len(before)))).first()[0]
    ends = [(a, bytearray(x)) for a, x in ((0, before), (end, after)) if x]
    write_ranges(placed.sortWithinPartitions("at").unionByName(rows.sparkSession.createDataFrame(ends, "at bigint, data binary")), path)
    released(placed)


def write_text(tree: Tree, path: str) -> None:
    _write_lines(tree_text(tree), ["ord"], path)


def _packed(rows: DataFrame, at: Column, columns: dict[str, str]) -> DataFrame:
    """rows as (at, data): the columns' numbers (name -> numpy type) one after another."""
    layout = np.dtype([(c, t) for c, t in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=layout)
            for k, c in enumerate(columns):
                out[c] = batch.column(k + 1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary())], names=["at", "data"])

    return rows.select(at.cast("bigint").alias("at"), *columns).sortWithinPartitions("at").mapInArrow(run, "at bigint, data binary")


def write_manta(tree: Tree, path: str) -> None:
    """uint32 number of items, int32 items, uint32 number of nodes, 8 bytes a node: a float or int, then bits is_leaf:1, plane_dim:2, child_idx:29."""
    spark = tree.leaves.sparkSession
    n_items, n_nodes = tree.leaves.count(), tree.nodes.count()
    items = _packed(manta_items(tree), F.col("pos") * 4 + 4, {"tri": "<i4"})
    bits = F.col("is_leaf").cast("bigint").bitwiseOR(F.shiftleft(F.col("plane_dim").cast("bigint"), 1)).bitwiseOR(F.shiftleft("child_idx", 3))
    nodes = manta_nodes(tree).withColumns({"bits": bits, "plane_pos": F.coalesce("plane_pos", F.lit(0.0).cast("float"))})
    first = F.col("idx") * 8 + (8 + 4 * n_items)
    leaves = _packed(nodes.filter("is_leaf"), first, {"num_prims": "<i4", "bits": "<u4"})
    splits = _packed(nodes.filter("not is_leaf"), first, {"plane_pos": "<f4", "bits": "<u4"})
    heads = spark.createDataFrame([(0, bytearray(struct.pack("<I", n_items))), (4 + 4 * n_items, bytearray(struct.pack("<I", n_nodes)))], "at bigint, data binary")
    write_ranges(items.unionByName(leaves).unionByName(splits).unionByName(heads), path)


def write_graphviz(tree: Tree, path: str, path_counts: bool = False) -> None:
    counts = tree_path_counts(tree).select("node", F.col("path_n").alias("shown")) if path_counts else tree.nodes.select("node", F.col("n").alias("shown"))
    name = lambda c: F.concat(F.lit("  n"), c.cast("string"))
    label = F.concat(name(F.col("node")), F.lit(' [label="'), F.col("depth").cast("string"), F.lit(": "), F.col("shown").cast("string"), F.lit('"];'))
    edge = F.when(F.col("node") > 1, F.concat(name(F.expr("shiftright(node, 1)")), F.lit(" -> n"), F.col("node").cast("string"), F.lit(";")))
    rows = tree.nodes.join(counts, "node").select("node", F.concat_ws("\n", label, edge).alias("line"))
    _write_lines(rows, ["node"], path, b"digraph tree {\n", b"}\n")
