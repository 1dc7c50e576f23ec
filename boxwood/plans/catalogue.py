"""The registered queries: every operator over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwood.operators import edges as E
from boxwood.operators import keys as O
from boxwood.operators import planes as P
from boxwood.operators import split as S
from boxwood.operators.ordering import running
from boxwood.plans import sql as Q
from boxwood.plans.tree import Tree, build, mesh_extent, normalized, root_node
from boxwood.schema import BOUNDS, DEPTH, EXTENT
from boxwood.sources import meshes as M
from boxwood.sources import sinks as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
B, X = ", ".join(BOUNDS), ", ".join(EXTENT)
#: Edges of an axis that make a chunk in the queries about chunks: t below, t from 0 to 0.1, and above.
CUTS = [[0.0, 0.1]] * 3
_CHUNK_SQL = "CASE WHEN t >= CAST(0.1 AS FLOAT) THEN 2 WHEN t >= 0 THEN 1 ELSE 0 END"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


class Root:
    """The root of the tree over the embedding triangles: boxes, edges, prices, split, and both children."""

    def __init__(self, spark: SparkSession, d: str):
        self.mesh = normalized(M.mesh_embed(spark, d))
        self.mem = O.with_keys(self.mesh).withColumn("node", F.lit(1).cast("bigint"))
        self.nodes = root_node(self.mesh)
        self.edges = E.create_edges(self.mesh)

    def divided(self, chunks: int) -> DataFrame:
        """mem with each axis in so many chunks."""
        return O.with_keys(self.mesh, bounds=E.key_bounds(self.mem, chunks)).withColumn("node", F.lit(1).cast("bigint"))

    @property
    def priced(self) -> DataFrame:
        return P.named(P.edge_costs(self.mem, self.nodes))

    @property
    def splits(self) -> DataFrame:
        return P.best_planes(self.priced)

    @property
    def sided(self) -> DataFrame:
        return S.sides(self.mem, self.splits)


ROOT0, ROOT1 = Q.levels(Q.EMBED, 0), Q.levels(Q.EMBED, 1)
EDGES0 = ROOT0 + f", e AS ({Q.unpivot('mesh', 'tri')}) "
CHUNKS0 = EDGES0 + f", k AS (SELECT *, {_CHUNK_SQL} AS chunk FROM e), p AS (SELECT axis, chunk, count(*) FILTER (et = 0) AS starts, count(*) FILTER (et = 1) AS ends FROM k GROUP BY axis, chunk) "


# --- meshes ------------------------------------------------------------------------------------


@query("tri_bounds", f"SELECT tri, {B} FROM ({Q.EMBED})")
def _(spark, d):
    return normalized(M.triangle_bounds(M.embed_corners(spark, d)))


@query("mesh_extent", ROOT0 + f" SELECT {X} FROM n0")
def _(spark, d):
    return mesh_extent(Root(spark, d).mesh)


_OBJ_CORNERS = ", ".join(f"v{i}{c}" for i in range(3) for c in "xyz")
_OBJ = f"WITH c AS (SELECT *, CAST(tri % 2 AS INTEGER) AS file_id, row_number() OVER (PARTITION BY tri % 2 ORDER BY tri) - 1 AS k FROM ({Q.CORNERS})) "


@query("obj_parse", _OBJ + " UNION ALL ".join(f"SELECT file_id, CAST(3 * k + {i} AS BIGINT) AS vid, v{i}x AS x, v{i}y AS y, v{i}z AS z FROM c" for i in range(3)))
def _(spark, d):
    return M.obj_tables(M.obj_tokens(M.obj_lines(spark, d)))[0]


@query("face_vertex_join", _OBJ + f"SELECT file_id, CAST(k AS BIGINT) AS fid, {_OBJ_CORNERS} FROM c")
def _(spark, d):
    return M.face_corners(*M.obj_tables(M.obj_tokens(M.obj_lines(spark, d))))


@query("multi_mesh_union", _OBJ + f", b AS (SELECT file_id, k, {', '.join(f'{g}(v0{c}, v1{c}, v2{c}) AS {c}{n}' for c in 'xyz' for n, g in ((0, 'least'), (1, 'greatest')))} FROM c) SELECT CAST(k + CASE WHEN file_id = 1 THEN (SELECT count(*) FROM c WHERE file_id = 0) ELSE 0 END AS BIGINT) AS tri, {B} FROM b")
def _(spark, d):
    return M.concatenated(M.face_boxes(*M.obj_tables(M.obj_tokens(M.obj_lines(spark, d)))))


# --- edges -------------------------------------------------------------------------------------


@query("create_edges", EDGES0 + "SELECT tri, axis, et, t FROM e")
def _(spark, d):
    return Root(spark, d).edges


@query("edge_projection", EDGES0 + "SELECT axis, t, et, tri FROM e WHERE axis = 0")
def _(spark, d):
    return Root(spark, d).edges.filter("axis = 0").select("axis", "t", "et", "tri")


@query("sorted_edges", EDGES0 + "SELECT axis, t, tri, et, row_number() OVER (PARTITION BY axis ORDER BY t, tri, et) - 1 AS pos FROM e")
def _(spark, d):
    return E.positions(Root(spark, d).edges).select("axis", "t", "tri", "et", "pos")


@query("edge_positions", EDGES0 + ", s AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY t, tri, et) - 1 AS pos FROM e) SELECT tri, " + ", ".join(f"max(pos) FILTER (axis = {a} AND et = {e}) AS {'xyz'[a]}{e}" for a in range(3) for e in (0, 1)) + " FROM s GROUP BY tri")
def _(spark, d):
    return E.edge_positions(Root(spark, d).edges)


@query("triangles_by_x", ROOT0 + " SELECT tri, x0, row_number() OVER (ORDER BY x0, tri) - 1 AS pos FROM mesh")
def _(spark, d):
    rows = Root(spark, d).mesh.select("tri", "x0")
    return running(rows, ["x0", "tri"], {"pos": F.lit(1)}).withColumn("pos", F.col("pos") - 1)


_RUNS = EDGES0 + ", a AS (SELECT t, tri, et FROM e WHERE axis = 0 AND tri % 2 = 0), b AS (SELECT t, tri, et FROM e WHERE axis = 0 AND tri % 2 = 1) "


def _two_runs(spark, d):
    x = Root(spark, d).edges.filter("axis = 0").select("t", "tri", "et")
    return x.filter("tri % 2 = 0"), x.filter("tri % 2 = 1")


@query("merge_sorted_runs", _RUNS + "SELECT t, tri, et, row_number() OVER (ORDER BY t, tri, et) - 1 AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b)")
def _(spark, d):
    a, b = _two_runs(spark, d)
    return running(a.unionByName(b), ["t", "tri", "et"], {"pos": F.lit(1)}).withColumn("pos", F.col("pos") - 1)


@query("merge_split_rank", _RUNS + "SELECT a.tri, a.et, (SELECT count(*) FROM b WHERE b.t <= a.t) AS rank FROM a")
def _(spark, d):
    # The upper bound of each edge of one run in the other: a running count over the merged order, in place of a range join.
    a, b = _two_runs(spark, d)
    both = a.withColumn("run", F.lit(1)).unionByName(b.withColumn("run", F.lit(0)))
    ranked = running(both, ["t", "run", "tri", "et"], {"rank": 1 - F.col("run")})
    return ranked.filter("run = 1").select("tri", "et", "rank")


# --- counts and planes -------------------------------------------------------------------------


@query("running_counts", ROOT1 + " SELECT axis, t, tri, et, na, nb FROM r0")
def _(spark, d):
    return Root(spark, d).priced.select("axis", "t", "tri", "et", "na", "nb")


def _chunked(spark, d):
    e = Root(spark, d).edges
    return e.withColumn("chunk", E.chunk_of(F.col("t"), F.col("axis"), CUTS))


@query("prescan_counts", CHUNKS0 + "SELECT axis, chunk, starts, ends FROM p")
def _(spark, d):
    return E.prescan(_chunked(spark, d), ("axis", "chunk"))


_BEFORE = ", ".join(f"CAST(coalesce(sum({c}) OVER (PARTITION BY axis ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {c}_before" for c in ("starts", "ends"))


@query("prescan_offsets", CHUNKS0 + f"SELECT *, {_BEFORE} FROM p")
def _(spark, d):
    return E.prescan_offsets(E.prescan(_chunked(spark, d), ("axis", "chunk")), ("axis",))


@query("prescan_counts_by_node", ROOT1 + f", e1 AS ({Q.unpivot('mem1', 'node, tri')}), k AS (SELECT *, {_CHUNK_SQL} AS chunk FROM e1) SELECT node, axis, chunk, count(*) FILTER (et = 0) AS starts, count(*) FILTER (et = 1) AS ends FROM k GROUP BY node, axis, chunk")
def _(spark, d):
    r = Root(spark, d)
    e = E.create_edges(S.classify(r.mem, r.splits), ("node", "tri"))
    return E.prescan(e.withColumn("chunk", E.chunk_of(F.col("t"), F.col("axis"), CUTS)), ("node", "axis", "chunk"))


@query("running_counts_chunked", ROOT1 + " SELECT axis, t, tri, et, na, nb FROM r0")
def _(spark, d):
    r = Root(spark, d)
    return P.named(P.edge_costs(r.divided(8), r.nodes, chunked=True)).select("axis", "t", "tri", "et", "na", "nb")


@query("sah_cost", ROOT1 + " SELECT axis, tri, et, sah FROM c0")
def _(spark, d):
    return Root(spark, d).priced.select("axis", "tri", "et", "sah")


@query("sah_root_best", ROOT1 + " SELECT axis, t, tri, et, na, nb, sah FROM c0 ORDER BY sah, axis, t, tri, et LIMIT 1")
def _(spark, d):
    return Root(spark, d).priced.orderBy("sah", "axis", "t", "tri", "et").limit(1).select("axis", "t", "tri", "et", "na", "nb", "sah")


@query("best_plane", ROOT1 + " SELECT node, axis, t, tri, et, na, nb, sah FROM sp0")
def _(spark, d):
    return P.named(Root(spark, d).splits).select(*P.SPLIT)


# --- one split ---------------------------------------------------------------------------------


@query("splittable_nodes", Q.levels(Q.EMBED, 2) + " SELECT node, n FROM n1 WHERE node IN (SELECT node FROM sp1)")
def _(spark, d):
    r = Root(spark, d)
    mem, nodes = S.classify(r.mem, r.splits), S.child_extents(r.nodes, r.splits)
    return nodes.join(P.best_planes(P.edge_costs(mem, nodes)).select("node"), "node", "left_semi").select("node", "n")


@query("child_extents", ROOT1 + f" SELECT node, depth, {X}, n FROM n1")
def _(spark, d):
    r = Root(spark, d)
    return S.child_extents(r.nodes, r.splits)


@query("child_nodes", ROOT1 + " SELECT node, depth, n FROM n1 WHERE n > 0")
def _(spark, d):
    r = Root(spark, d)
    return S.child_extents(r.nodes, r.splits).filter("n > 0").select("node", "depth", "n")


@query("classify_triangles", ROOT1 + " SELECT node, tri FROM mem1")
def _(spark, d):
    r = Root(spark, d)
    return S.classify(r.mem, r.splits).select("node", "tri")


@query("node_extent_join", ROOT1 + f" SELECT m.node, m.tri, {', '.join('n.' + c for c in EXTENT)} FROM mem1 m JOIN n1 n ON m.node = n.node")
def _(spark, d):
    r = Root(spark, d)
    return S.classify(r.mem, r.splits).join(S.child_extents(r.nodes, r.splits), "node").select("node", "tri", *EXTENT)


@query("edge_membership_join", ROOT1 + ", e AS (" + Q.unpivot("mesh", "tri") + ") SELECT m.node, e.tri, e.axis, e.et, e.t FROM e JOIN mem1 m ON e.tri = m.tri")
def _(spark, d):
    r = Root(spark, d)
    return r.edges.join(S.classify(r.mem, r.splits).select("node", "tri"), "tri").select("node", "tri", "axis", "et", "t")


def _filter_geom(side: str) -> None:
    @query(f"filter_geom_{side}", ROOT1 + f", e AS ({Q.unpivot('mesh', 'tri')}) SELECT tri, axis, et, t FROM e WHERE tri IN (SELECT tri FROM cl0 WHERE goes_{side})")
    def _(spark, d):
        r = Root(spark, d)
        return r.edges.join(r.sided.filter(f"goes_{side}").select("tri"), "tri", "left_semi").select("tri", "axis", "et", "t")


_filter_geom("left")
_filter_geom("right")


@query("filter_geom_offsets", ROOT1 + ", e AS (" + Q.unpivot("mesh", "tri") + ") SELECT axis, tri, et, row_number() OVER (PARTITION BY axis ORDER BY t, tri, et) - 1 AS pos FROM e WHERE tri IN (SELECT tri FROM cl0 WHERE goes_left)")
def _(spark, d):
    r = Root(spark, d)
    kept = r.edges.join(r.sided.filter("goes_left").select("tri"), "tri", "left_semi")
    return E.positions(kept).select("axis", "tri", "et", "pos")


@query("straddling_triangles", ROOT1 + " SELECT tri FROM cl0 WHERE goes_left INTERSECT SELECT tri FROM cl0 WHERE goes_right")
def _(spark, d):
    s = Root(spark, d).sided
    return s.filter("goes_left").select("tri").intersect(s.filter("goes_right").select("tri"))


@query("left_only_triangles", ROOT1 + " SELECT tri FROM cl0 WHERE goes_left EXCEPT SELECT tri FROM cl0 WHERE goes_right")
def _(spark, d):
    s = Root(spark, d).sided
    return s.filter("goes_left").select("tri").exceptAll(s.filter("goes_right").select("tri"))


@query("split_counts", ROOT1 + " SELECT node, count(*) FILTER (goes_left) AS n_left, count(*) FILTER (goes_right) AS n_right, count(*) FILTER (goes_left AND goes_right) AS n_straddle FROM cl0 GROUP BY node")
def _(spark, d):
    left, right = F.col("goes_left"), F.col("goes_right")
    return Root(spark, d).sided.groupBy("node").agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"), F.count_if(left & right).alias("n_straddle"))


@query("node_counts", ROOT1 + " SELECT node, count(*) AS n FROM mem1 GROUP BY node")
def _(spark, d):
    r = Root(spark, d)
    return S.classify(r.mem, r.splits).groupBy("node").agg(F.count("*").alias("n"))


@query("side_bitmask", ROOT1 + " SELECT tri, CAST(CASE WHEN goes_left THEN 1 ELSE 0 END + CASE WHEN goes_right THEN 2 ELSE 0 END AS INTEGER) AS mask FROM cl0")
def _(spark, d):
    return Root(spark, d).sided.select("tri", F.col("goes_left").cast("int").bitwiseOR(F.shiftleft(F.col("goes_right").cast("int"), 1)).alias("mask"))


@query("membership_flags", ROOT1 + ", s AS (SELECT tri, bool_or(node = 2) AS in_left, bool_or(node = 3) AS in_right FROM mem1 GROUP BY tri) SELECT * FROM s")
def _(spark, d):
    r = Root(spark, d)
    return S.classify(r.mem, r.splits).groupBy("tri").agg(F.bool_or(F.col("node") == 2).alias("in_left"), F.bool_or(F.col("node") == 3).alias("in_right"))


@query("membership_sets", ROOT1 + " SELECT tri, array_to_string(list(node ORDER BY node), ',') AS nodes, count(*) AS n_nodes FROM mem1 GROUP BY tri")
def _(spark, d):
    r = Root(spark, d)
    own = S.classify(r.mem, r.splits).groupBy("tri").agg(F.sort_array(F.collect_list("node")).alias("a"))
    return own.select("tri", F.array_join(F.transform("a", lambda x: x.cast("string")), ",").alias("nodes"), F.size("a").cast("bigint").alias("n_nodes"))


@query("presplit_counts", ROOT1 + f", e AS ({Q.unpivot('mesh', 'tri')}), k AS (SELECT e.axis, {_CHUNK_SQL} AS chunk, c.goes_left, c.goes_right FROM e JOIN cl0 c ON e.tri = c.tri), p AS (SELECT axis, chunk, count(*) FILTER (goes_left) AS n_left, count(*) FILTER (goes_right) AS n_right FROM k GROUP BY axis, chunk) SELECT *, CAST(coalesce(sum(n_left) OVER (PARTITION BY axis ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_before FROM p")
def _(spark, d):
    r = Root(spark, d)
    rows = E.create_edges(r.sided, ("tri", "goes_left", "goes_right")).withColumn("chunk", E.chunk_of(F.col("t"), F.col("axis"), CUTS))
    counts = rows.groupBy("axis", "chunk").agg(F.count_if("goes_left").alias("n_left"), F.count_if("goes_right").alias("n_right"))
    before = Window.partitionBy("axis").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("left_before", F.coalesce(F.sum("n_left").over(before), F.lit(0)).cast("bigint"))


# --- whole trees -------------------------------------------------------------------------------

TREE = Q.tree(Q.EMBED, DEPTH)
SMALL = Q.tree(Q.ORDERS, 4)


def _tree(spark: SparkSession, d: str, finish_below: int = 64, **how) -> Tree:
    return build(M.mesh_embed(spark, d), finish_below=finish_below, **how)


@query("kd_tree_leaves", TREE + "SELECT node, tri FROM leaves")
def _(spark, d):
    return _tree(spark, d).leaves


@query("kd_tree_nodes", TREE + f"SELECT node, depth, {X}, n, is_leaf FROM nodes")
def _(spark, d):
    return _tree(spark, d).nodes


@query("kd_tree_splits", TREE + "SELECT * FROM splits")
def _(spark, d):
    return _tree(spark, d).splits


@query("kd_tree_levels", Q.tree(Q.EMBED, 4) + "SELECT node, tri FROM leaves")
def _(spark, d):
    return _tree(spark, d, finish_below=0, max_depth=4).leaves


@query("kd_tree_hybrid", SMALL + "SELECT node, tri FROM leaves")
def _(spark, d):
    return build(M.mesh_orders(spark, d), max_depth=4, finish_below=4000).leaves


@query("leaf_nodes", TREE + "SELECT node, n FROM nodes WHERE is_leaf")
def _(spark, d):
    return _tree(spark, d).nodes.filter("is_leaf").select("node", "n")


@query("leaf_triangles", TREE + "SELECT l.node, l.tri, m.x0, m.x1 FROM leaves l JOIN mesh m ON l.tri = m.tri")
def _(spark, d):
    return _tree(spark, d).leaves.join(Root(spark, d).mesh.select("tri", "x0", "x1"), "tri").select("node", "tri", "x0", "x1")


@query("leaf_lists", TREE + "SELECT node, array_to_string(ids, ',') AS ids FROM lists")
def _(spark, d):
    return K.leaf_lists(_tree(spark, d)).select("node", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("tree_text", TREE + "SELECT row_number() OVER (ORDER BY k, depth) - 1 AS ord, array_to_string(ids, ' ') || ' ' AS line FROM pre JOIN lists USING (node)")
def _(spark, d):
    return K.tree_text(_tree(spark, d))


_IDX = "CASE WHEN p.node = 1 THEN 0 ELSE 2 * q.rank - 1 + p.node % 2 END"


@query("manta_nodes", TREE + f"SELECT CAST({_IDX} AS BIGINT) AS idx, p.is_leaf, coalesce(s.axis, 0) AS plane_dim, s.t AS plane_pos, CAST(CASE WHEN p.is_leaf THEN p.n ELSE 0 END AS INTEGER) AS num_prims, CAST(CASE WHEN p.is_leaf THEN p.\"offset\" ELSE 2 * p.rank - 1 END AS BIGINT) AS child_idx FROM pre p LEFT JOIN pre q ON p.node // 2 = q.node LEFT JOIN splits s ON p.node = s.node")
def _(spark, d):
    return K.manta_nodes(_tree(spark, d))


@query("manta_items", TREE + "SELECT row_number() OVER (ORDER BY p.k, p.depth, l.tri) - 1 AS pos, l.tri FROM leaves l JOIN pre p ON l.node = p.node")
def _(spark, d):
    return K.manta_items(_tree(spark, d))


@query("tree_graph_edges", TREE + "SELECT node // 2 AS parent, node AS child, depth || ': ' || n AS label FROM nodes WHERE node > 1")
def _(spark, d):
    return K.tree_graph_edges(_tree(spark, d))


@query("tree_path_counts", TREE + "SELECT a.node, a.n, CAST(sum(b.n) AS BIGINT) AS path_n FROM nodes a JOIN nodes b ON b.depth <= a.depth AND a.node >> (a.depth - b.depth) = b.node GROUP BY a.node, a.n")
def _(spark, d):
    return K.tree_path_counts(_tree(spark, d))


@query("split_trace", TREE + "SELECT n.depth AS level, s.node, ['x', 'y', 'z'][s.axis + 1] AS axis, CASE s.et WHEN 0 THEN 'STR' ELSE 'END' END AS edge, s.t, s.tri, s.na, s.nb, s.sah FROM splits s JOIN nodes n ON s.node = n.node")
def _(spark, d):
    return K.split_trace(_tree(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).leaves
