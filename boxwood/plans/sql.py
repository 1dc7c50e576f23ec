"""The same computations as SQL for DuckDB: common table expressions that the catalogue's oracles select from."""

from __future__ import annotations

from boxwood.functions.sah import Costs
from boxwood.schema import BOUNDS, EXTENT

_E = "CAST({0} AS FLOAT)"


def _corner(i: int, k: int) -> str:
    first = f"embedding[{k + 1}]"
    return first if i == 0 else f"CAST({first} + CAST(0.1 AS FLOAT) * embedding[{k + 1 + 3 * i}] AS FLOAT)"


CORNERS = "SELECT CAST(vec_id AS BIGINT) AS tri, " + ", ".join(f"{_corner(i, k)} AS v{i}{'xyz'[k]}" for i in range(3) for k in range(3)) + " FROM embeddings"
_BOUNDS_OF = ", ".join(f"CAST({g}(v0{c}, v1{c}, v2{c}) + CAST(0 AS FLOAT) AS FLOAT) AS {c}{k}" for c in "xyz" for k, g in ((0, "least"), (1, "greatest")))
EMBED = f"SELECT tri, {_BOUNDS_OF} FROM ({CORNERS})"
ORDERS = """SELECT CAST(o_orderkey AS BIGINT) AS tri, x AS x0, CAST(x + CAST(2000 AS FLOAT) AS FLOAT) AS x1, y AS y0, CAST(y + CAST(o_custkey % 5 AS FLOAT) AS FLOAT) AS y1,
  z AS z0, CAST(z + CAST(o_orderkey % 10 AS FLOAT) AS FLOAT) AS z1
  FROM (SELECT *, CAST(o_totalprice AS FLOAT) AS x, CAST(o_custkey AS FLOAT) AS y, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS FLOAT) AS z FROM orders)"""


def axis_case(axis: str, values: tuple[str, str, str]) -> str:
    return f"CASE {axis} WHEN 0 THEN {values[0]} WHEN 1 THEN {values[1]} ELSE {values[2]} END"


def sah(axis: str = "axis", na: str = "na", nb: str = "nb", t: str = "t", costs: Costs = Costs()) -> str:
    d = [f"({h} - {low})" for low, h in zip(EXTENT[::2], EXTENT[1::2], strict=True)]
    surface = f"({d[0]} * {d[1]} + {d[1]} * {d[2]} + {d[2]} * {d[0]})"
    inv = f"(CAST(0.5 AS FLOAT) / {surface})"
    side = f"({axis_case(axis, (f'{d[1]} * {d[2]}', f'{d[2]} * {d[0]}', f'{d[0]} * {d[1]}'))})"
    rim = f"({axis_case(axis, (f'{d[1]} + {d[2]}', f'{d[2]} + {d[0]}', f'{d[0]} + {d[1]}'))})"
    lo, hi = f"({axis_case(axis, EXTENT[::2])})", f"({axis_case(axis, EXTENT[1::2])})"
    two, box, step, keep = (_E.format(x) for x in (2, costs.box, costs.step, 1 - costs.bonus))
    left, right = f"({two} * ({side} + ({t} - {lo}) * {rim}) * {inv})", f"({two} * ({side} + ({hi} - {t}) * {rim}) * {inv})"
    a, b = f"CAST({na} AS FLOAT)", f"CAST({nb} AS FLOAT)"
    return f"""CASE WHEN {surface} > 0 THEN CAST(CASE WHEN {t} < {lo} OR {t} > {hi} THEN CAST(3.4028234663852886e38 AS FLOAT)
      WHEN {na} = 0 AND {t} > {lo} THEN {step} + {box} * {right} * {b} * {keep}
      WHEN {nb} = 0 AND {t} < {hi} THEN {step} + {box} * {left} * ({a} + {b}) * {keep}
      ELSE {step} + {box} * ({left} * {a} + {right} * {b}) END AS FLOAT) END"""


def unpivot(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, {axis} AS axis, {et} AS et, {BOUNDS[2 * axis + et]} AS t FROM {source}" for axis in range(3) for et in (0, 1))


def _level(k: int, costs: Costs) -> str:
    """e, r, sp of level k; mem and n of level k + 1."""
    low, high = axis_case("s.axis", BOUNDS[::2]), axis_case("s.axis", BOUNDS[1::2])
    extent = ", ".join(f"CASE WHEN s.axis = {i // 2} AND side.s = {1 - i % 2} THEN s.t ELSE n.{c} END AS {c}" for i, c in enumerate(EXTENT))
    bounds = ", ".join(BOUNDS)
    return f""",
e{k} AS MATERIALIZED ({unpivot(f'mem{k}', 'node, tri')}),
r{k} AS MATERIALIZED (
  SELECT e.node, e.tri, e.axis, e.et, e.t, n.n, {', '.join('n.' + c for c in EXTENT)},
    CAST(coalesce(sum(1 - et) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS na,
    CAST(n.n - sum(et) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS nb
  FROM e{k} e JOIN n{k} n ON e.node = n.node WINDOW w AS (PARTITION BY e.node, axis ORDER BY t, tri, et)),
c{k} AS MATERIALIZED (SELECT *, {sah(costs=costs)} AS sah FROM r{k}),
sp{k} AS MATERIALIZED (
  SELECT node, axis, t, tri, et, na, nb, sah FROM c{k} WHERE sah < CAST(n AS FLOAT) * {_E.format(costs.box)}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY sah, axis, t, tri, et) = 1),
cl{k} AS MATERIALIZED (
  SELECT m.*, ({low}, m.tri, 0) < (s.t, s.tri, s.et) AS goes_left, ({high}, m.tri, 1) > (s.t, s.tri, s.et) AS goes_right
  FROM mem{k} m JOIN sp{k} s ON m.node = s.node),
mem{k + 1} AS MATERIALIZED (
  SELECT 2 * node AS node, tri, {bounds} FROM cl{k} WHERE goes_left UNION ALL SELECT 2 * node + 1, tri, {bounds} FROM cl{k} WHERE goes_right),
n{k + 1} AS MATERIALIZED (
  SELECT 2 * n.node + side.s AS node, n.depth + 1 AS depth, {extent}, CASE WHEN side.s = 0 THEN s.na ELSE s.nb END AS n
  FROM n{k} n JOIN sp{k} s ON n.node = s.node CROSS JOIN (VALUES (0), (1)) side(s))"""


def root(mesh: str) -> str:
    ends = ", ".join(f"{'max' if i % 2 else 'min'}({b}) AS {c}" for i, (b, c) in enumerate(zip(BOUNDS, EXTENT, strict=True)))
    return f"""WITH mesh AS MATERIALIZED ({mesh}),
mem0 AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS node, tri, {', '.join(BOUNDS)} FROM mesh),
n0 AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth, {ends}, count(*) AS n FROM mesh)"""


def levels(mesh: str, depth: int, costs: Costs = Costs()) -> str:
    """The expressions down to a depth."""
    return root(mesh) + "".join(_level(k, costs) for k in range(depth))


def tree(mesh: str, depth: int, costs: Costs = Costs()) -> str:
    """levels, and the whole tree: nodes, splits, leaves."""
    splits = " UNION ALL ".join(f"SELECT * FROM sp{k}" for k in range(depth))
    nodes = " UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(depth + 1))
    members = " UNION ALL ".join([f"SELECT node, tri FROM mem{k} WHERE node NOT IN (SELECT node FROM sp{k})" for k in range(depth)] + [f"SELECT node, tri FROM mem{depth}"])
    return (
        levels(mesh, depth, costs)
        + f""",
splits AS MATERIALIZED ({splits}),
nodes AS MATERIALIZED (SELECT n.*, n.node NOT IN (SELECT node FROM splits) AS is_leaf FROM ({nodes}) n),
leaves AS MATERIALIZED ({members}),
lists AS (SELECT node, list(tri ORDER BY tri) AS ids FROM leaves GROUP BY node),
pre AS MATERIALIZED (
  SELECT *, node << ({depth} - depth) AS k, sum(CASE WHEN is_leaf THEN 0 ELSE 1 END) OVER w AS rank,
    sum(CASE WHEN is_leaf THEN n ELSE 0 END) OVER w - CASE WHEN is_leaf THEN n ELSE 0 END AS "offset"
  FROM nodes WINDOW w AS (ORDER BY node << ({depth} - depth), depth))
"""
    )
