import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwood.functions.sah import Costs
from boxwood.operators.ordering import running
from boxwood.plans.finish import finish
from boxwood.plans.tree import build
from boxwood.schema import BOUNDS, BOXES
from boxwood.sources import meshes, sinks


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in rows], BOXES)


def random_rows(n, seed):
    """Boxes with ties, flat and point extents."""
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 12, (n, 3)) / 2
    high = low + rng.integers(0, 4, (n, 3)) / 2
    return [(i, [x for k in range(3) for x in (low[i, k], high[i, k])]) for i in range(n)]


def leaves(tree):
    return sorted(map(tuple, tree.leaves.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_and_finisher_agree(spark, seed):
    rows = random_rows(60, seed)
    mesh = boxes(spark, rows)
    whole = build(mesh, max_depth=4)
    levels = build(mesh, max_depth=4, finish_below=0)
    mixed = build(mesh, max_depth=4, finish_below=25)
    assert leaves(whole) == leaves(levels) == leaves(mixed)
    table = lambda t: sorted(map(str, t.nodes.collect()))
    assert table(whole) == table(levels) == table(mixed)
    assert {tri for _, tri in leaves(whole)} == {i for i, _ in rows}


def test_counts_of_children(spark):
    tree = build(boxes(spark, random_rows(80, 5)), max_depth=5)
    n = {r["node"]: r["n"] for r in tree.nodes.collect()}
    for s in tree.splits.collect():
        assert n[2 * s["node"]] == s["na"] and n[2 * s["node"] + 1] == s["nb"]


def test_empty_one_and_equal_boxes(spark):
    assert leaves(build(boxes(spark, []))) == []
    assert leaves(build(boxes(spark, [(7, [0, 1, 0, 1, 0, 1])]))) == [(1, 7)]
    same = build(boxes(spark, [(i, [0, 0, 0, 0, 0, 0]) for i in range(5)]))
    assert leaves(same) == [(1, i) for i in range(5)]


def test_null_bound_is_refused(spark):
    with pytest.raises(Exception, match="null"):
        build(spark.createDataFrame([(1, None, 1.0, 0.0, 1.0, 0.0, 1.0)], BOXES))


def test_obj_and_blob(spark, tmp_path):
    obj = tmp_path / "a.obj"
    obj.write_text("# v 9 9 9\nv 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 2\nf 1/1 2/2 3/3\nf 2 4 3 1\n")
    got = {r["tri"]: tuple(r)[1:] for r in meshes.load(spark, [str(obj), str(obj)]).collect()}
    assert got == {0: (0, 1, 0, 1, 0, 0), 1: (0, 1, 0, 1, 0, 2), 2: (0, 1, 0, 1, 0, 0), 3: (0, 1, 0, 1, 0, 2)}
    rows = [(0, *map(float, [0, 1, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0]))]
    blob = tmp_path / "a.blob"
    blob.write_bytes(b"".join(meshes.pack_blob(rows, 1)))
    assert [tuple(r) for r in meshes.read_blob(spark, str(blob)).collect()] == rows
    with pytest.raises(ValueError):
        meshes.load(spark, ["a.xyz"])


def test_sinks(spark, tmp_path):
    tree = build(boxes(spark, random_rows(40, 9)), max_depth=3)
    path = str(tmp_path / "t.txt")
    sinks.write_text(tree, path)
    lines = open(path).read().splitlines()
    assert sum(len(x.split()) for x in lines) == tree.leaves.count() and all(x.endswith(" ") for x in lines)
    sinks.write_manta(tree, str(tmp_path / "k"))
    n, m = tree.leaves.count(), tree.nodes.count()
    assert (tmp_path / "k").stat().st_size == 4 + 4 * n + 4 + 8 * m
    assert sorted(r["idx"] for r in sinks.manta_nodes(tree).collect()) == [0, *range(1, m)]


def test_sinks_by_content(spark, tmp_path):
    """The packed binary, read back by its layout, holds the tree's leaves and planes; GraphViz has each edge once."""
    tree = build(boxes(spark, random_rows(60, 11)), max_depth=4)
    sinks.write_manta(tree, str(tmp_path / "k"))
    raw = (tmp_path / "k").read_bytes()
    (n_items,) = struct.unpack_from("<I", raw)
    items = struct.unpack_from(f"<{n_items}i", raw, 4)
    (n_nodes,) = struct.unpack_from("<I", raw, 4 + 4 * n_items)
    at = lambda k: 8 + 4 * n_items + 8 * k
    leaves_, planes = {}, {}

    def walk(k, node):
        (bits,) = struct.unpack_from("<I", raw, at(k) + 4)
        if bits & 1:
            (n,) = struct.unpack_from("<i", raw, at(k))
            leaves_[node] = sorted(items[bits >> 3 : (bits >> 3) + n])
        else:
            planes[node] = (bits >> 1 & 3, struct.unpack_from("<f", raw, at(k))[0])
            walk(bits >> 3, 2 * node)
            walk((bits >> 3) + 1, 2 * node + 1)

    walk(0, 1)
    want = {r["node"]: [] for r in tree.nodes.filter("is_leaf").collect()}
    for r in tree.leaves.orderBy("tri").collect():
        want[r["node"]].append(r["tri"])
    assert leaves_ == want and n_nodes == len(raw[at(0) :]) // 8 == len(leaves_) + len(planes)
    assert planes == {r["node"]: (r["axis"], r["t"]) for r in tree.splits.collect()}
    lines = [" ".join(map(str, want[k])) + " " for k in sorted(want, key=lambda k: (k << (4 - k.bit_length() + 1), k.bit_length())) if want[k]]
    assert [r["line"] for r in sinks.tree_text(tree).orderBy("ord").collect()] == lines
    for summed in (False, True):
        sinks.write_graphviz(tree, str(tmp_path / "g.dot"), summed)
        text = (tmp_path / "g.dot").read_text()
        assert sorted(re.findall(r"-> n(\d+);", text)) == sorted(str(r["node"]) for r in tree.nodes.filter("node > 1").collect())
        n = {r["node"]: (r["depth"], r["n"]) for r in tree.nodes.collect()}
        of = lambda k: sum(n[k >> i][1] for i in range(n[k][0] + 1)) if summed else n[k][1]  # noqa: E731, B023
        assert dict(re.findall(r'n(\d+) \[label="\d+: (\d+)"', text)) == {str(k): str(of(k)) for k in n}


def test_running_sums(spark):
    """One order over many ranges, with ties and a column that is summed from nothing."""
    rng = random.Random(5)
    rows = [(rng.randint(0, 20), i, rng.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, n int")
    got = {r["b"]: (r["pos"], r["total"]) for r in running(df, ["a", "b"], {"pos": F.lit(1), "total": F.col("n")}).collect()}
    total, want = 0, {}
    for k, (a, b, n) in enumerate(sorted(rows)):
        total += n
        want[b] = (k + 1, total)
    assert got == want and running(df.limit(0), ["a"], {"pos": F.lit(1)}).count() == 0


def test_obj_over_splits(spark, tmp_path):
    """Lines keep their order where a file is read in many splits, two files with numbers of their own."""
    rng = random.Random(6)
    for name, count in (("a.obj", 400), ("b.obj", 90)):
        corners = [[rng.randint(0, 99) for _ in range(3)] for _ in range(3 * count)]
        with open(tmp_path / name, "w") as f:
            for k in range(count):
                f.writelines("v {} {} {}\n".format(*c) for c in corners[3 * k : 3 * k + 3])
                f.write(f"f {3 * k + 1} {3 * k + 2} {3 * k + 3}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = meshes.read_obj_triangles(spark, [str(tmp_path / x) for x in ("a.obj", "b.obj")]).orderBy("tri").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = []
    for name in ("a.obj", "b.obj"):
        v = [list(map(float, x.split()[1:])) for x in open(tmp_path / name) if x[0] == "v"]
        want += [v[3 * k] + v[3 * k + 1] + v[3 * k + 2] for k in range(len(v) // 3)]
    assert [list(r)[7:] for r in got] == want and [r["tri"] for r in got] == list(range(490))


def test_finish_alone():
    tri = np.arange(3)
    bounds = np.array([[0, 1, 0, 1, 0, 1], [5, 6, 0, 1, 0, 1], [9, 10, 0, 1, 0, 1]], dtype=np.float32)
    done = finish(1, 0, np.array([0, 10, 0, 1, 0, 1], dtype=np.float32), tri, bounds, 8, Costs())
    assert sorted(int(t) for _, x in done.leaves for t in x) == [0, 1, 2] and len(BOUNDS) == 6
