"""The order (t, tri, et) of an axis's edges as one number for each edge, made once for a whole build.

A float32 has 32 bits that sort as it does (once the negative ones are turned
around), a box's number 31, the edge type one: a long sorts, compares and splits equal
t like the three columns. No two edges of an axis share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwood.operators.ordering import running
from boxwood.schema import BOUNDS, CHUNKS, KEYS
from boxwood.storage import written

#: Boxes' numbers have so many bits; a tree holds at most 2^31 boxes.
ID_BITS = 31


def keys_of(t: np.ndarray, ids: np.ndarray, et: int) -> np.ndarray:
    bits = (t.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
    return np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) << (ID_BITS + 1) | ids << 1 | et


def with_keys(boxes: DataFrame, number: str = "tri", bounds: list[list[int]] | None = None) -> DataFrame:
    """boxes with KEYS and CHUNKS; the column number has their numbers, from 0 to 2^31 - 1. bounds: the keys at which each axis is divided into chunks."""
    names = boxes.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema)
    cuts = [np.array(own, dtype=np.int64) for own in bounds or ([], [], [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(names.index(number)).to_numpy()
            keys = [keys_of(batch.column(names.index(c)).to_numpy(), ids, k % 2) for k, c in enumerate(BOUNDS)]
            chunks = [np.searchsorted(cuts[k // 2], key, side="right").astype(np.int32) for k, key in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys), *map(pa.array, chunks)], names=[*names, *KEYS, *CHUNKS])

    return boxes.mapInArrow(run, kinds + "".join(f", {k} bigint" for k in KEYS) + "".join(f", {c} int" for c in CHUNKS))


def numbered(boxes: DataFrame, n: int, low: int, high: int) -> tuple[DataFrame, bool]:
    """boxes (n of them, with tri from low to high) with the column number: tri itself where it fits, else (True) the place of tri among all of them."""
    if 0 <= low and high < 1 << ID_BITS:
        return boxes.withColumn("number", F.col("tri")), False
    if n > 1 << ID_BITS:
        raise ValueError(f"over 2^{ID_BITS} boxes")
    places = running(boxes, ["tri"], {"number": F.lit(1)})
    return written(places.withColumn("number", F.col("number") - 1)), True


def number_of(key: Column) -> Column:
    return F.shiftright(key, 1).bitwiseAND(F.lit((1 << ID_BITS) - 1))


def edge_type(key: Column) -> Column:
    return key.bitwiseAND(F.lit(1).cast("bigint")).cast("int")
