"""Running sums along an order of all rows, or of the rows of each key, without a task that holds them all."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwood.storage import written

_DIRECTION = re.compile(r"^(?P<of>.*?)(?P<down>\s+(?:asc|desc))?(?P<nulls>\s+nulls\s+(?:first|last))?$", re.I | re.S)


def ordering(term: str | Column) -> Column:
    """A term of an order: a column's name or any SQL expression, with asc or desc and nulls first or last, or a Column.

    As in Spark's ORDER BY, NaN is above all numbers, -0.0 equals 0.0, and
    nulls come first in a rising order and last in a falling one, unless it says otherwise.
    """
    if isinstance(term, Column):
        return term
    m = _DIRECTION.match(term.strip())
    down = (m["down"] or "").strip().lower() == "desc"
    first = m["nulls"].lower().endswith("first") if m["nulls"] else not down
    of = F.expr(m["of"])
    return {(False, True): of.asc_nulls_first, (False, False): of.asc_nulls_last, (True, True): of.desc_nulls_first, (True, False): of.desc_nulls_last}[down, first]()


def running(rows: DataFrame, order: list[str | Column], sums: dict[str, Column], keys: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """rows with the sum of each column of sums over all rows up to the row's own, in the given order; with keys, over the rows of the same key.

    Rows are divided into ``parts`` ranges of (keys, order), as many as there
    are shuffle partitions unless set, wherever that cuts: within a key, too. Each range is summed on its
    own, and totals of the ranges before are added: of keys that lie in several ranges, of
    which there are fewer than ranges. Rows that are equal in the order may
    come in any order, so may keys; keys aren't null.
    """
    terms = [ordering(x) for x in order]
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.withColumns({f"_{name}": of.cast("bigint") for name, of in sums.items()})
    ranges = written(held.repartitionByRange(parts, *map(F.col, keys), *terms).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *keys).orderBy(*terms).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range", *keys).agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    totals = totals.select("_range", *keys, *(F.sum(f"_{name}").over(before).alias(f"_before_{name}") for name in sums), F.row_number().over(Window.partitionBy(*keys).orderBy("_range")).alias("_nth"))
    totals = totals.filter("_nth > 1").drop("_nth")
    summed = ranges.withColumns({name: F.sum(f"_{name}").over(within) for name in sums})
    out = summed.join(F.broadcast(totals), ["_range", *keys], "left")
    return out.select(*rows.columns, *((F.col(name) + F.coalesce(f"_before_{name}", F.lit(0))).alias(name) for name in sums))
