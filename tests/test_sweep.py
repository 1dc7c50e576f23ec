"""Orders, sweeps by segments, arg-min, packed subtrees and builders: against numpy, DuckDB SQL and each other."""

import random
from statistics import median

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwood.functions.sah import Costs
from boxwood.operators import edges, keys, planes
from boxwood.operators.ordering import running
from boxwood.plans import sql, tree
from boxwood.schema import BOXES
from boxwood.sources import meshes

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in rows], BOXES)


def test_keys_sort_as_columns():
    """Keys order edges as (t, tri, et), with negative numbers, ties, infinities and both zeros."""
    rng = random.Random(1)
    t = np.array([rng.choice([-3.5, -0.0, 0.0, 1e-40, -1e-40, 2.0, float("inf"), float("-inf"), rng.uniform(-9, 9)]) for _ in range(400)], dtype=np.float32)
    ids = np.array([rng.choice([0, 1, 5, 2**31 - 1]) for _ in range(400)])
    et = np.array([rng.randint(0, 1) for _ in range(400)])
    key = np.where(et == 0, keys.keys_of(t, ids, 0), keys.keys_of(t, ids, 1))
    order = np.lexsort((et, ids, t + np.float32(0)))
    assert (np.diff(key[order]) >= 0).all()
    assert [int(k) >> 1 & (2**31 - 1) for k in key] == ids.tolist() and (key & 1).tolist() == et.tolist()


def test_rank_holds_cost_and_place(spark):
    """The double that stands for (cost, place) sorts as they do, up to the next float32."""
    rng = random.Random(2)
    costs = [np.float32(x) for x in (0.0, 1.0, -1.0, 15.0, 3e38, -2.5, 1e-38, 1e-45)] + [np.float32(rng.uniform(1, 1e6)) for _ in range(50)]
    costs += [np.nextafter(c, np.float32(np.inf)) for c in costs]
    places = [0, 1, 2, 3, 2**28 - 2, 2**28 - 1]
    rows = [(float(c), p) for c in costs for p in places]
    got = spark.createDataFrame(rows, "sah float, place bigint").select("sah", "place", planes._rank(F.col("sah"), F.col("place")).alias("k")).collect()
    by = sorted({(r["sah"], r["place"], r["k"]) for r in got})
    assert all(a[2] < b[2] for a, b in zip(by, by[1:]))


def test_segments_cut_equal_values(spark):
    """A mesh flat in y: positions and counts come from more than three tasks, and from chunks within one t."""
    rng = np.random.default_rng(3)
    rows = [(4096 * i, [*np.sort(rng.integers(0, 50, 2)), 7, 7, *np.sort(rng.integers(0, 3, 2))]) for i in range(900)]  # quantiles are doubles, which hold a key but for its last 11 bits
    mesh = boxes(spark, rows)
    e = edges.create_edges(mesh)
    placed = running(e, list(edges.ORDER), {"pos": F.lit(1)}, keys=("axis",), parts=12)
    got = {(r["axis"], r["tri"], r["et"]): r["pos"] for r in placed.collect()}
    for axis in range(3):
        own = sorted((float(b[2 * axis + et]), i, et) for i, b in rows for et in (0, 1))
        assert [got[axis, i, et] for _, i, et in own] == list(range(1, 1801))
    mem = keys.with_keys(mesh)
    bounds = edges.key_bounds(mem, 16)
    assert all(len(b) >= 12 for b in bounds)  # y, too, though all its t are equal
    whole = mem.withColumn("node", F.lit(1).cast("bigint"))
    divided = keys.with_keys(mesh, bounds=bounds).withColumn("node", F.lit(1).cast("bigint"))
    nodes = tree.root_node(mesh)
    table = lambda df: sorted((r["axis"], r["key"], r["na"], r["nb"], r["sah"]) for r in df.collect())
    swept = planes.edge_costs(divided, nodes, chunked=True)
    assert table(swept) == table(planes.edge_costs(whole, nodes))
    assert swept.select("group").distinct().count() > 30
    assert planes.best_planes(swept).collect() == planes.best_planes(planes.edge_costs(whole, nodes)).collect()
    assert "SortAggregate" not in plan_of(planes.best_planes(swept)) and plan_of(planes.best_planes(swept)).count("HashAggregate") >= 4


@pytest.mark.parametrize("costs", [Costs(), Costs(1.0, 2.0, 0.25), Costs(40.0, 10.0, -0.5), Costs(15.0, 20.0, 1.5)])
def test_cheapest_planes_from_few_edges(spark, costs):
    """Chunks that can't hold the cheapest plane aren't swept; the planes are those of the full sweep: two nodes, ties, empty ends, a node without surface, infinite bounds."""
    rng = np.random.default_rng(7)
    low = rng.integers(0, 60, (1500, 3)) * np.array([1, 9, 2])
    low[:300, 0] += 400
    rows = [(4096 * i, [x for k in range(3) for x in (low[i, k], low[i, k] + rng.integers(0, 4))]) for i in range(1500)]
    rows += [(4096 * i, [1, 1, 2, 2, 0, 5]) for i in range(1500, 1600)] + [(4096 * i, [float("-inf"), 1, 2, 2, 0, float(i)]) for i in range(1600, 1650)]
    mesh = boxes(spark, rows)
    node = F.when(F.col("tri") >= 4096 * 1600, 4).when(F.col("tri") >= 4096 * 1500, 3).otherwise(F.when(F.col("x0") > 30, 2).otherwise(1)).cast("bigint")
    own = keys.with_keys(mesh, bounds=edges.key_bounds(keys.with_keys(mesh), 64)).withColumn("node", node)
    parts = [tree.root_node(own.filter(F.col("node") == k)).withColumn("node", F.lit(k).cast("bigint")) for k in (1, 2, 3, 4)]
    nodes = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    full, few = (planes.edge_costs(own, nodes, costs, chunked=True, cheapest=c) for c in (False, True))
    planes_of = lambda priced: sorted(map(tuple, planes.best_planes(priced, costs).collect()))
    assert planes_of(few) == planes_of(full) and len(planes_of(full)) >= 2
    swept = lambda priced: priced.filter("node < 3").count()
    assert swept(few) <= swept(full) // (3 if costs == Costs() else 1)


def test_orders_as_in_sql(spark):
    """running takes orders as expressions; NaN, nulls, signs of zero and directions as DuckDB has them."""
    rng = random.Random(4)
    rows = [(k, rng.choice([None, float("nan"), 0.0, -0.0, 1.5, -2.0, 7.0]), rng.choice([None, "a", "b", "B", ""]), rng.randint(-3, 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, x double, s string, n int")
    con = duckdb.connect()
    con.sql("CREATE TABLE t (k INT, x DOUBLE, s VARCHAR, n INT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    orders = [["x desc nulls last", "k"], ["s nulls last", "abs(n) desc", "k desc"], ["x nulls first", F.col("n").desc(), "k"]]
    for order, text in zip(orders, ("x DESC NULLS LAST, k", "s ASC NULLS LAST, abs(n) DESC, k DESC", "x ASC NULLS FIRST, n DESC, k")):
        got = sorted((r["k"], r["total"]) for r in running(df, order, {"total": F.col("n")}, parts=7).collect())
        want = con.sql(f"SELECT k, sum(n) OVER (ORDER BY {text} ROWS UNBOUNDED PRECEDING) FROM t ORDER BY k").fetchall()
        assert got == [(a, int(b)) for a, b in want]


def test_subtrees_packed(spark):
    """Of many subtrees of uneven size, no task has twice the median's work; of few, the largest is alone."""
    rng = random.Random(5)
    sizes = [int(rng.paretovariate(1.2) * 20) for _ in range(400)]
    nodes = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "node bigint, n bigint")
    packed, count = tree.packed_subtrees(nodes, 16)
    work = {}
    for r in packed.collect():
        work[r["task"]] = work.get(r["task"], 0) + r["n"] * np.log2(r["n"] + 1)
    assert len(work) == count and max(work.values()) < 2 * median(work.values())
    assert sum(1 for _ in packed.collect()) == 400
    few, count = tree.packed_subtrees(nodes.limit(3).withColumn("n", F.when(F.col("node") == 1, 5000).otherwise(10).cast("bigint")), 16)
    assert count == 1 and few.count() == 3


def leaves_of(built):
    return sorted(map(tuple, built.leaves.collect()))


@pytest.mark.parametrize("costs", [Costs(1.0, 2.0, 0.25), Costs(40.0, 10.0, 0.0)])
def test_builders_and_costs(spark, costs):
    """All builders give the tree of the SQL, whatever the costs."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.sql(sql.tree(sql.EMBED, 4, costs) + "SELECT node, tri FROM leaves").fetchall())
    mesh = meshes.mesh_embed(spark, SF)
    for how in tree.BUILDERS:
        assert leaves_of(tree.build(mesh, 4, costs, finish_below=60, builder=how)) == want, how
    with pytest.raises(ValueError, match="builder"):
        tree.build(mesh, builder="other")


def test_ids_beyond_31_bits(spark):
    """Ids that the keys can't hold are numbered by place; the tree has the ids."""
    rng = np.random.default_rng(6)
    low = rng.integers(0, 20, (60, 3))
    rows = [(i, [x for k in range(3) for x in (low[i, k], low[i, k] + rng.integers(0, 3))]) for i in range(60)]
    far = lambda i: 2**40 * (i - 20) + i
    near, wide = (tree.build(boxes(spark, r), 4, finish_below=15) for r in (rows, [(far(i), b) for i, b in rows]))
    assert leaves_of(wide) == sorted((node, far(i)) for node, i in leaves_of(near))
    assert sorted((r["node"], far(r["tri"]), r["sah"]) for r in near.splits.collect()) == sorted((r["node"], r["tri"], r["sah"]) for r in wide.splits.collect())


def test_tables_of_levels_go(spark):
    """What is left of a build is what its result reads: no boxes of levels that are done."""
    from pathlib import Path

    from boxwood.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    built = tree.build(meshes.mesh_embed(spark, SF), 5, finish_below=60)
    left = [p for p in set(folder.iterdir()) - before if any("kx0" in spark.read.parquet(str(f)).columns for f in p.rglob("part-*.parquet"))]
    assert all({d.name for d in p.glob("state=*")} <= {"state=0"} for p in left)
    assert built.leaves.count() == len(leaves_of(built)) > 500
