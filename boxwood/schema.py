"""Column names of boxes, nodes and edges."""

from __future__ import annotations

#: A box's bounds and a node's extent, axis by axis.
BOUNDS = ("x0", "x1", "y0", "y1", "z0", "z1")
EXTENT = ("lx", "hx", "ly", "hy", "lz", "hz")
#: Of each bound, its place in the order (t, tri, et) of its axis, as one number (operators.keys).
KEYS = ("kx0", "kx1", "ky0", "ky1", "kz0", "kz1")
#: Of each key, the chunk of its axis in which it is swept.
CHUNKS = ("cx0", "cx1", "cy0", "cy1", "cz0", "cz1")
BOXES = "tri bigint, " + ", ".join(f"{c} float" for c in BOUNDS)
#: Edge types: a box starts before it ends.
START, END = 0, 1
#: The largest float32, and the default costs of a step, of a box, and the bonus for empty space.
FLT_MAX = 3.4028234663852886e38
STEP_COST, BOX_COST, EMPTY_BONUS = 15.0, 20.0, 0.0
DEPTH = 8
