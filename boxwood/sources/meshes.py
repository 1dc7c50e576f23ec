"""Meshes: OBJ text, packed blobs, Parquet, and boxes from the test tables."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwood.functions.sah import f32
from boxwood.operators.ordering import running
from boxwood.schema import BOUNDS, FLT_MAX
from boxwood.sources.ranges import BLOB_FLOATS, HEAD, PACKED, RECORD, VERTEX, read_blob, write_ranges



def obj_tokens(lines: DataFrame) -> DataFrame:
    """lines (file_id, line_no, line) as kind ('v' or 'f') and the next three fields; other lines go.

    The kind stands at the beginning of a line (after white space), so that a
    comment's words are no vertices.
    """
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("file_id", "line_no", parts.alias("p")).filter(F.get("p", F.lit(0)).isin("v", "f"))
    return rows.select("file_id", "line_no", F.get("p", F.lit(0)).alias("kind"), *(F.get("p", F.lit(k)).alias(f"p{k}") for k in (1, 2, 3)))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Contiguous numbers from 0 within each file, by line."""
    numbered = running(rows, ["file_id", "line_no"], {name: F.lit(1)})
    first = numbered.groupBy("file_id").agg(F.min(name).alias("_first"))
    return numbered.join(F.broadcast(first), "file_id").withColumn(name, F.col(name) - F.col("_first")).drop("_first")


def obj_tables(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices (file_id, vid, x, y, z) and faces (file_id, fid, a, b, c), numbered from 0; of a face with more corners the first three count."""
    vertices = _numbered(tokens.filter("kind = 'v'"), "vid").select("file_id", "vid", *(F.col(f"p{k}").cast("float").alias("xyz"[k - 1]) for k in (1, 2, 3)))
    index = lambda k: (F.regexp_extract(f"p{k}", r"^(-?\d+)", 1).cast("bigint") - 1).alias("abc"[k - 1])
    faces = _numbered(tokens.filter("kind = 'f'"), "fid").select("file_id", "fid", index(1), index(2), index(3))
    wrong = (F.col("a") < 0) | (F.col("b") < 0) | (F.col("c") < 0)
    faces = faces.withColumn("a", F.when(wrong, F.raise_error(F.lit("an index of a face is not positive"))).otherwise(F.col("a")))
    return vertices, faces


def face_boxes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """file_id, fid, bounds: one join and one aggregation for all corners."""
    corners = faces.select("file_id", "fid", F.explode(F.array("a", "b", "c")).alias("vid"))
    met = corners.join(vertices, ["file_id", "vid"])
    bounds = [g(c).alias(f"{c}{k}") for c in "xyz" for k, g in ((0, F.min), (1, F.max))]
    return met.groupBy("file_id", "fid").agg(*bounds)


def face_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """file_id, fid and the nine coordinates, by three equi-joins."""
    out = faces
    for k, name in enumerate("abc"):
        v = vertices.select("file_id", F.col("vid").alias(name), *(F.col(c).alias(f"v{k}{c}") for c in "xyz"))
        out = out.join(v, ["file_id", name])
    return out.select("file_id", "fid", *VERTEX)


def triangle_bounds(rows: DataFrame) -> DataFrame:
    """rows with the bounds of their corners v0x to v2z."""
    return rows.withColumns({f"{c}{k}": g(*(F.col(f"v{i}{c}") for i in range(3))).cast("float") for c in "xyz" for k, g in ((0, F.least), (1, F.greatest))})


def _obj_tables_of(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of OBJ files. Splits of a file are read by several tasks; a line's place is that of its split, then its own in it."""
    parts = None
    for i, path in enumerate(paths):
        place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        lines = spark.read.text(path).select(F.lit(i).alias("file_id"), place.alias("line_no"), F.col("value").alias("line"))
        parts = lines if parts is None else parts.unionByName(lines)
    return obj_tables(obj_tokens(parts))


def read_obj(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Boxes of OBJ files (plain or .bz2), one after another; a path that is missing is an error. Faces point into their own file."""
    return concatenated(face_boxes(*_obj_tables_of(spark, paths)))


def read_obj_triangles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As read_obj, with the corners v0x to v2z, too."""
    return concatenated(triangle_bounds(face_corners(*_obj_tables_of(spark, paths))), (*BOUNDS, *VERTEX))


def concatenated(boxes: DataFrame, columns: tuple[str, ...] = BOUNDS) -> DataFrame:
    """Boxes with file_id and fid, numbered through: a file's ids follow those of the files before."""
    sizes = boxes.groupBy("file_id").agg((F.max("fid") + 1).alias("size"))
    first = sizes.withColumn("first", F.coalesce(F.sum("size").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return boxes.join(F.broadcast(first), "file_id").select((F.col("fid") + F.col("first")).alias("tri"), *columns)


def pack_blob(triangles: Iterable[tuple], n: int) -> Iterator[bytes]:
    """Bytes of n triangles (tri, bounds, corners) as they come, for small meshes that are at hand: the number, the triangles, the extent."""
    rows = np.array([r[1:] for r in triangles], dtype="<f4").reshape(-1, BLOB_FLOATS)[:, PACKED]
    yield struct.pack("<i", n)
    yield rows.tobytes()
    yield rows[:, :3].min(0, initial=FLT_MAX).tobytes() + rows[:, 3:6].max(0, initial=-FLT_MAX).tobytes()


def write_blob(triangles: DataFrame, path: str) -> None:
    """A packed mesh, its triangles in the order of tri, written by as many tasks as there are partitions: a triangle's place says where its bytes go."""
    spark = triangles.sparkSession
    placed = running(triangles.select("tri", *BOUNDS, *VERTEX), ["tri"], {"place": F.lit(1)})
    ends = triangles.agg(F.count("*"), *(F.min(c) for c in BOUNDS[::2]), *(F.max(c) for c in BOUNDS[1::2])).first()
    n, low, high = ends[0], ends[1:4], ends[4:]
    low, high = ([FLT_MAX] * 3, [-FLT_MAX] * 3) if not n else (low, high)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy() - 1
            data = np.column_stack([batch.column(k + 1).to_numpy() for k in PACKED]).astype("<f4") if len(place) else np.zeros((0, BLOB_FLOATS), "<f4")
            yield pa.RecordBatch.from_arrays([pa.array(HEAD + RECORD * place), pa.array([row.tobytes() for row in data], pa.binary())], names=["at", "data"])

    body = placed.select("place", *BOUNDS, *VERTEX).sortWithinPartitions("place").mapInArrow(pack, "at bigint, data binary")
    rest = [(0, struct.pack("<i", n)), (HEAD + RECORD * n, np.array([*low, *high], dtype="<f4").tobytes())]
    write_ranges(body.unionByName(spark.createDataFrame([(a, bytearray(d)) for a, d in rest], "at bigint, data binary")), path)


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Boxes of several files, by suffix: .obj and .obj.bz2 follow one another, a .blob replaces what came before, Parquet holds boxes."""
    boxes, waiting = None, []
    for path in paths:
        if path.endswith((".obj", ".obj.bz2")):
            waiting.append(path)
        elif path.endswith(".blob"):
            boxes, waiting = read_blob(spark, path).select("tri", *BOUNDS), []
        elif path.endswith(".parquet"):
            boxes, waiting = spark.read.parquet(path).select("tri", *BOUNDS), []
        else:
            raise ValueError(f"unknown kind of file: {path}")
    if waiting:
        more = read_obj(spark, waiting)
        if boxes is not None:
            base = boxes.agg(F.coalesce(F.max("tri") + 1, F.lit(0)).alias("base"))
            more = boxes.unionByName(more.crossJoin(F.broadcast(base)).select((F.col("tri") + F.col("base")).alias("tri"), *BOUNDS))
        boxes = more
    return boxes


# --- boxes from the test tables --------------------------------------------------------------


def embed_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k]
    corner = lambda i, k: e(k) if i == 0 else e(k) + f32(0.1) * e(k + 3 * i)
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select(F.col("vec_id").cast("bigint").alias("tri"), *(corner(i, k).cast("float").alias(f"v{i}{'xyz'[k]}") for i in range(3) for k in range(3)))


def mesh_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triangle_bounds(embed_corners(spark, sf_dir)).select("tri", *BOUNDS)


def mesh_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y, z = F.col("o_totalprice").cast("float"), F.col("o_custkey").cast("float"), F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("float")
    wide = lambda c: c.cast("float")
    ends: list[Column] = [x, x + f32(2000.0), y, y + wide(F.col("o_custkey") % 5), z, z + wide(F.col("o_orderkey") % 10)]
    return o.select(F.col("o_orderkey").cast("bigint").alias("tri"), *(c.cast("float").alias(n) for c, n in zip(ends, BOUNDS, strict=True)))


def obj_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, line_no, line: the embedding triangles written as OBJ, three vertices and a face each, in two files."""
    rows = embed_corners(spark, sf_dir).withColumn("file_id", (F.col("tri") % 2).cast("int"))
    at = F.row_number().over(Window.partitionBy("file_id").orderBy("tri")).cast("bigint") - 1
    number = lambda c: F.col(c).cast("double").cast("string")
    rows = rows.withColumn("k", at)
    lines = [F.concat(F.lit("v "), number(f"v{i}x"), F.lit(" "), number(f"v{i}y"), F.lit(" "), number(f"v{i}z")) for i in range(3)]
    corner = lambda i: F.concat((F.col("k") * 3 + i + 1).cast("string"), F.lit("/1"))
    lines.append(F.concat(F.lit("f "), corner(0), F.lit(" "), corner(1), F.lit(" "), corner(2)))
    return rows.select("file_id", F.posexplode(F.array(*lines)).alias("i", "line"), "k").select("file_id", (F.col("k") * 4 + F.col("i")).alias("line_no"), "line")
