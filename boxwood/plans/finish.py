"""The rest of a tree below one node, in one task: numpy, float32 throughout, with the results of the distributed steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from boxwood.functions.sah import Costs
from boxwood.schema import FLT_MAX

F32 = np.float32


@dataclass
class Done:
    """Rows of nodes (node, depth, extent, n), of splits (node, axis, t, tri, et, na, nb, sah), and of leaves (node, tri)."""

    nodes: list[tuple]
    splits: list[tuple]
    leaves: list[tuple[int, np.ndarray]]


def prices(axis: int, low: np.ndarray, high: np.ndarray, na: np.ndarray, nb: np.ndarray, t: np.ndarray, costs: Costs) -> np.ndarray | None:
    """Costs of the planes at t; None where the surface has no area."""
    d = high - low
    surface = d[0] * d[1] + d[1] * d[2] + d[2] * d[0]
    if not surface > 0:
        return None
    inv = F32(0.5) / surface
    one, two = (axis + 1) % 3, (axis + 2) % 3
    side, rim = d[one] * d[two], d[one] + d[two]
    left = F32(2) * (side + (t - low[axis]) * rim) * inv
    right = F32(2) * (side + (high[axis] - t) * rim) * inv
    a, b = na.astype(F32), nb.astype(F32)
    step, box, keep = F32(costs.step), F32(costs.box), F32(1) - F32(costs.bonus)
    out = step + box * (left * a + right * b)
    out = np.where((nb == 0) & (t < high[axis]), step + box * left * (a + b) * keep, out)
    out = np.where((na == 0) & (t > low[axis]), step + box * right * b * keep, out)
    return np.where((t < low[axis]) | (t > high[axis]), F32(FLT_MAX), out)


def best_plane(tri: np.ndarray, bounds: np.ndarray, extent: np.ndarray, costs: Costs) -> tuple | None:
    """(axis, t, tri, et, na, nb, sah) of the plane to split at. bounds: rows x 6; extent: low and high of each axis."""
    n, best = len(tri), None
    low, high = extent[::2], extent[1::2]
    ids, ends = np.concatenate([tri, tri]), np.repeat(np.array([0, 1]), n)
    for axis in range(3):
        t = np.concatenate([bounds[:, 2 * axis], bounds[:, 2 * axis + 1]])
        order = np.lexsort((ends, ids, t))
        et, t = ends[order], t[order]
        nb = n - np.cumsum(et)
        na = np.cumsum(1 - et) - (1 - et)
        sah = prices(axis, low, high, na, nb, t, costs)
        if sah is None:
            return None
        k = int(np.argmin(sah))
        if best is None or sah[k] < best[-1]:
            best = (axis, t[k], int(ids[order][k]), int(et[k]), int(na[k]), int(nb[k]), sah[k])
    return best if best and best[-1] < F32(n) * F32(costs.box) else None


def finish(node: int, depth: int, extent: np.ndarray, tri: np.ndarray, bounds: np.ndarray, max_depth: int, costs: Costs) -> Done:
    """The subtree of node; open nodes wait in a list, so that depth costs no stack."""
    done = Done([], [], [])
    todo = [(node, depth, extent, tri, bounds)]
    while todo:
        node, depth, extent, tri, bounds = todo.pop()
        done.nodes.append((node, depth, extent, len(tri)))
        plane = best_plane(tri, bounds, extent, costs) if depth < max_depth and len(tri) else None
        if plane is None:
            if len(tri):
                done.leaves.append((node, tri))
            continue
        axis, t, s_tri, s_et, *_ = plane
        done.splits.append((node, *plane))
        low, high = bounds[:, 2 * axis], bounds[:, 2 * axis + 1]
        left = (low < t) | ((low == t) & ((tri < s_tri) | ((tri == s_tri) & (0 < s_et))))
        right = (high > t) | ((high == t) & ((tri > s_tri) | ((tri == s_tri) & (1 > s_et))))
        for side, own in ((1, right), (0, left)):
            child = extent.copy()
            child[2 * axis + 1 - side] = t
            todo.append((2 * node + side, depth + 1, child, tri[own], bounds[own]))
    return done
