"""Costs of all planes of all nodes, and each node's best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwood.functions.sah import Costs, axis_terms, f32, plane_cost
from boxwood.operators.edges import CHUNK_BITS, keyed_edges, prescan_offsets, swept
from boxwood.operators.keys import edge_type, number_of
from boxwood.schema import FLT_MAX
from boxwood.storage import written

SPLIT = ("node", "axis", "t", "tri", "et", "na", "nb", "sah")
TERMS = ("lo", "hi", "side", "rim", "inv")
def node_axes(nodes: DataFrame) -> DataFrame:
    """node, axis, n and the cost's terms: three rows for each node, so that an edge's own expression stays small."""
    axes = nodes.withColumn("axis", F.explode(F.array(*map(F.lit, range(3)))))
    terms = axis_terms(F.col("axis"))
    return axes.select("node", "axis", "n", *(terms[k].alias(k) for k in TERMS))


def _least_cost(t_low: Column, t_high: Column, na: Column, nb: Column, costs: Costs) -> Column:
    """A bound below the costs of planes from t_low to t_high with at least na and nb boxes beside them.

    It is plane_cost's arithmetic, with the least of each operand: rounding keeps
    the order of float32 results, so no cost is below it by rounding either.
    """
    lo, hi, side, rim, inv = (F.col(k) for k in TERMS)
    left = f32(2.0) * (side + (F.greatest(t_low, lo) - lo) * rim) * inv
    right = f32(2.0) * (side + (hi - F.least(t_high, hi)) * rim) * inv
    a, b = na.cast("float"), nb.cast("float")
    step, box, keep = f32(costs.step), f32(costs.box), f32(1.0) - f32(costs.bonus)
    whole = step + box * (left * a + right * b)
    none_left = F.when(na == 0, step + box * right * b * keep).otherwise(whole)
    none_right = F.when(nb == 0, step + box * left * (a + b) * keep).otherwise(whole)
    return F.least(whole, none_left, none_right, f32(FLT_MAX))


def worthwhile(groups: DataFrame, costs: Costs) -> DataFrame:
    """groups (chunks, with first, t_low and t_high of their edges) that may hold the cheapest plane of their node.

    Of a chunk's first edge the cost is known; a chunk whose bound is above the
    cheapest of its node's first edges, or not below the cost of the whole node, has
    no plane that counts. Equal ones stay, so ties are decided as before.
    """
    et = edge_type(F.col("first"))
    terms = {k: F.col(k) for k in TERMS}
    known = plane_cost(F.col("starts_before"), F.col("n") - F.col("ends_before") - et, F.col("t_low"), terms, costs)
    known = F.when(~F.isnan("t_low") & ~F.isnan("t_high"), known)
    bound = _least_cost(F.col("t_low"), F.col("t_high"), F.col("starts_before"), F.col("n") - F.col("ends_before") - F.col("ends"), costs)
    rows = groups.withColumns({"_known": F.min(known).over(Window.partitionBy("node")), "_bound": bound})
    under = (F.col("_bound") <= F.coalesce("_known", F.col("_bound"))) & (F.col("_bound") < F.col("n").cast("float") * f32(costs.box))
    return rows.filter(under | F.isnan("_bound") | F.isnan("t_low") | F.isnan("t_high")).drop("_known", "_bound")


def edge_costs(mem: DataFrame, nodes: DataFrame, costs: Costs = Costs(), chunked: bool = False, cheapest: bool = False) -> DataFrame:
    """group, node, axis, place, key, t, na, nb, n, sah of every edge of every node. mem has KEYS and CHUNKS.

    chunked: a node's axis is swept in its chunks, each a group
    of its own that starts after the edges of the chunks before. What
    a group needs of its node and of the chunks before is a row that meets the
    edges where the sweep has put them, so edges move once.
    cheapest: edges of chunks that can't hold the cheapest plane of their
    node are left out, before they move; best_planes gives the same. It
    holds for chunked sweeps with costs that rise with the boxes.
    """
    edges, whole = keyed_edges(mem, chunked), node_axes(nodes)
    if chunked:
        start = F.lit(1) - edge_type(F.col("key"))
        cheapest = cheapest and costs.box >= 0 and costs.bonus <= 1
        ends = [F.min("key").alias("first"), F.min("t").alias("t_low"), F.max("t").alias("t_high")] if cheapest else []
        counts = edges.groupBy("group").agg(F.sum(start).alias("starts"), F.sum(F.lit(1) - start).alias("ends"), *ends)
        of = F.shiftright("group", CHUNK_BITS)
        counts = counts.withColumns({"node": F.floor(of / 3), "axis": F.pmod(of, F.lit(3)).cast("int")})
        groups = prescan_offsets(counts, ("node", "axis"), "group").drop("starts").join(whole, ["node", "axis"])
        if cheapest:
            groups = written(worthwhile(groups, costs).drop("first", "t_low", "t_high"))
            edges = edges.join(F.broadcast(groups.select("group")), "group", "left_semi")
        groups = groups.drop("ends")
    else:
        none = F.lit(0).cast("bigint")
        groups = whole.select("*", F.shiftleft(F.col("node") * 3 + F.col("axis"), CHUNK_BITS).alias("group"), none.alias("starts_before"), none.alias("ends_before"))
    found = swept(edges, "group").join(groups, "group")
    et = edge_type(F.col("key"))
    found = found.withColumns({"na": F.col("starts_before") + F.col("starts") - (F.lit(1) - et), "nb": F.col("n") - F.col("ends_before") - (F.col("place") - F.col("starts"))})
    cost = plane_cost(F.col("na"), F.col("nb"), F.col("t"), {k: F.col(k) for k in TERMS}, costs)
    return found.select("group", "node", "axis", "place", "key", "t", "na", "nb", "n", cost.alias("sah"))


def named(priced: DataFrame) -> DataFrame:
    """priced with tri and et, for boxes whose numbers are their ids."""
    return priced.withColumns({"tri": number_of(F.col("key")), "et": edge_type(F.col("key"))})


def _rank(sah: Column, place: Column) -> Column:
    """A double that sorts as (sah, place): a float32 leaves 29 of a double's bits free, which hold a place below 2^28."""
    cost, step = sah.cast("double"), place.cast("double") * F.lit(2.0**-52)
    return F.when(cost == 0, step * F.lit(2.0**-400)).otherwise(cost + F.abs(cost) * step)


def best_planes(priced: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """node, axis, t, key, na, nb, sah of the cheapest plane of each node that costs less than to leave the node whole; of equal ones the first by axis and place.

    Cost and place are one number, so both steps are hash aggregates.
    """
    least = lambda names: [F.min_by(c, "_k").alias(c) for c in names]
    first = priced.withColumn("_k", _rank(F.col("sah"), F.col("place"))).groupBy("group", "node", "axis", "n").agg(*least(("t", "key", "na", "nb", "sah")))
    chunk = F.col("group").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))
    among = first.withColumn("_k", _rank(F.col("sah"), F.shiftleft(F.col("axis").cast("bigint"), CHUNK_BITS) + chunk)).groupBy("node", "n").agg(*least(("axis", "t", "key", "na", "nb", "sah")))
    return among.filter(F.col("sah") < F.col("n").cast("float") * f32(costs.box)).drop("n")
