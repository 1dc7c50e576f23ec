"""Packed meshes and tree files that many tasks read and write; compressed meshes; box text; timings."""

import bz2
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwood.plans.tree import build
from boxwood.schema import BOUNDS
from boxwood.sources import meshes, ranges, sinks


def triangles(spark, n):
    corner = [F.sin(F.col("tri") * (k + 1)).cast("float").alias(c) for k, c in enumerate(ranges.VERTEX)]
    return meshes.triangle_bounds(spark.range(n).select(F.col("id").alias("tri"), *corner)).select("tri", *BOUNDS, *ranges.VERTEX)


def test_blob_by_ranges(spark, tmp_path):
    path, n = str(tmp_path / "a.blob"), 5003
    rows = triangles(spark, n)
    meshes.write_blob(rows.repartition(7), path)
    raw = (tmp_path / "a.blob").read_bytes()
    assert len(raw) == 28 + 60 * n and struct.unpack_from("<i", raw)[0] == n
    got = ranges.read_blob(spark, path, records=600)
    assert got.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    ends = np.frombuffer(raw[-24:], dtype="<f4")
    want = rows.agg(*(F.min(c) for c in BOUNDS[::2]), *(F.max(c) for c in BOUNDS[1::2])).first()
    assert ends.tolist() == list(want)
    meshes.write_blob(rows.limit(0), path)
    assert ranges.read_blob(spark, "file:" + path).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["a.blob"]
    (tmp_path / "b.blob").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="not a packed mesh"):
        ranges.read_blob(spark, str(tmp_path / "b.blob")).count()


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    path = tmp_path / "x"
    rows = spark.createDataFrame([(5, bytearray(b"world")), (0, bytearray(b"hello"))], "at bigint, data binary")
    ranges.write_ranges(rows.repartition(2), str(path))
    assert path.read_bytes() == b"helloworld"
    with pytest.raises(Exception, match="gaps"):
        ranges.write_ranges(rows.filter("at > 0"), str(path))
    failing = rows.withColumn("at", F.when(F.col("at") == 0, F.raise_error(F.lit("stop"))).otherwise(F.col("at")))
    with pytest.raises(Exception, match="stop"):
        ranges.write_ranges(failing, str(path))
    assert path.read_bytes() == b"helloworld" and [p.name for p in tmp_path.iterdir()] == ["x"]
    with pytest.raises(ValueError, match="shared file"):
        ranges.local("s3://bucket/x")


def test_tree_files_by_ranges(spark, tmp_path):
    """Text and GraphViz files have the lines of their tables in order, whatever the number of tasks."""
    tree = build(triangles(spark, 300).select("tri", *BOUNDS), max_depth=5, finish_below=40)
    sinks.write_text(tree, str(tmp_path / "t"))
    assert (tmp_path / "t").read_text().splitlines() == [r["line"] for r in sinks.tree_text(tree).orderBy("ord").collect()]
    sinks.write_graphviz(tree, str(tmp_path / "g"))
    want = ["digraph tree {"]
    for r in tree.nodes.orderBy("node").collect():
        want.append(f'  n{r["node"]} [label="{r["depth"]}: {r["n"]}"];')
        want += [f"  n{r['node'] >> 1} -> n{r['node']};"] if r["node"] > 1 else []
    assert (tmp_path / "g").read_text().splitlines() == [*want, "}"]
    empty = build(triangles(spark, 0).select("tri", *BOUNDS))
    sinks.write_text(empty, str(tmp_path / "e"))
    assert (tmp_path / "e").read_bytes() == b""


def test_compressed_mesh(spark, tmp_path):
    text = "v 0 0 0\nv 1 0 0\nv 0 1 2\nf 1 2 3\n"
    (tmp_path / "a.obj.bz2").write_bytes(bz2.compress(text.encode()))
    assert [tuple(r) for r in meshes.load(spark, [str(tmp_path / "a.obj.bz2")]).collect()] == [(0, 0, 1, 0, 1, 0, 2)]


def test_box_text(spark):
    row = spark.createDataFrame([(0.5, 1.0, -2.0, 3.25, 0.0, 100.0)], "lx float, hx float, ly float, hy float, lz float, hz float")
    assert row.select(sinks.format_box()).first()[0] == "[0.5,1.0]x[-2.0,3.25]x[0.0,100.0]"


def test_load_is_timed_where_it_happens(spark, tmp_path, capsys, monkeypatch):
    """The stamp of the loaded mesh waits for Spark to read it; phases name their jobs and tasks."""
    from boxwood.cli import main

    monkeypatch.chdir(tmp_path)
    took = []
    for name, n in (("warm", 1), ("small", 1), ("large", 60_000)):
        with open(tmp_path / f"{name}.obj", "w") as f:
            for k in range(n):
                f.write(f"v {k} 0 0\nv {k} 1 0\nv {k + 1} 0 1\nf {3 * k + 1} {3 * k + 2} {3 * k + 3}\n")
        assert main(["--csv", "-m", "1", "--builder", "tasks", "--costs", "15,20,0", str(tmp_path / f"{name}.obj")]) == 0
        row = next(x for x in capsys.readouterr().err.splitlines() if x.startswith("1,")).split(",")
        took.append(int(row[2]) - int(row[1]))
    assert took[2] > took[1]
    tree = build(triangles(spark, 50).select("tri", *BOUNDS), max_depth=2, finish_below=0)
    rows = {(r["phase"], r["level"]): (r["jobs"], r["tasks"]) for r in tree.timings.table().collect()}
    assert rows["findBestPlane", 0][0] >= 1 and rows["classifyTriangles", 0][1] >= 1
    report = {r["phase"]: (r["times"], r["total_us"], r["mean_us"]) for r in tree.timings.report().collect()}
    assert report["newGen"][0] >= 1 and report["newGen"][1] == pytest.approx(report["newGen"][0] * report["newGen"][2])
    with pytest.raises(SystemExit):
        main(["--costs", "1,2", "x.obj"])
    with pytest.raises(SystemExit):
        main(["--builder", "none", "x.obj"])
