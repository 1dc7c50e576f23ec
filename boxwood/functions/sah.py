"""The surface-area cost of a split plane, in float32.

The association of the operations is part of the result, so every operand is
a float column: Spark turns float / float and float * bigint into doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxwood.schema import BOX_COST, EMPTY_BONUS, EXTENT, FLT_MAX, STEP_COST


def f32(x: float | Column) -> Column:
    return (F.lit(x) if isinstance(x, float | int) else x).cast("float")


def by_axis(axis: Column, values: tuple[Column, Column, Column]) -> Column:
    return F.when(axis == 0, values[0]).when(axis == 1, values[1]).otherwise(values[2])


@dataclass(frozen=True)
class Costs:
    step: float = STEP_COST
    box: float = BOX_COST
    bonus: float = EMPTY_BONUS


def axis_terms(axis: Column, extent: tuple[str, ...] = EXTENT) -> dict[str, Column]:
    """What the cost takes from a node and an axis: lo and hi, the area across (side), half the rim, and inv, null without surface."""
    low, high = [F.col(c) for c in extent[::2]], [F.col(c) for c in extent[1::2]]
    d = [h - l for l, h in zip(low, high, strict=True)]
    surface = d[0] * d[1] + d[1] * d[2] + d[2] * d[0]
    return {
        "lo": by_axis(axis, tuple(low)),
        "hi": by_axis(axis, tuple(high)),
        "side": by_axis(axis, (d[1] * d[2], d[2] * d[0], d[0] * d[1])),
        "rim": by_axis(axis, (d[1] + d[2], d[2] + d[0], d[0] + d[1])),
        "inv": F.when(surface > 0, (f32(0.5) / surface).cast("float")),
    }


def plane_cost(na: Column, nb: Column, pos: Column, terms: dict[str, Column], costs: Costs = Costs()) -> Column:
    """Cost of a plane at pos, with na boxes to its left and nb to its right, from a node's terms for the axis.

    A plane outside the extent costs the largest float; a node whose surface
    has no area has no cost (null), so it isn't split.
    """
    lo, hi, side, rim, inv = (terms[k] for k in ("lo", "hi", "side", "rim", "inv"))
    left = f32(2.0) * (side + (pos - lo) * rim) * inv
    right = f32(2.0) * (side + (hi - pos) * rim) * inv
    a, b = na.cast("float"), nb.cast("float")
    step, box, keep = f32(costs.step), f32(costs.box), f32(1.0) - f32(costs.bonus)
    inside = (
        F.when((na == 0) & (pos > lo), step + box * right * b * keep)
        .when((nb == 0) & (pos < hi), step + box * left * (a + b) * keep)
        .otherwise(step + box * (left * a + right * b))
    )
    return F.when(inv.isNotNull(), F.when((pos < lo) | (pos > hi), f32(FLT_MAX)).otherwise(inside)).cast("float")
