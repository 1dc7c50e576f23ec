"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of at most ``BLOCK`` vectors, which bounds what is
broadcast. For a block, every pass scores all rows against all its queries and
counts the scores of each query in equal bins of the range that still holds
its kth largest value; the counts, summed over the tasks, show the bin to
refine. When the range is one value, that value is the kth score: rows above
it are kept, and of those that equal it the smallest ids, of which a task
needs to give no more than k. A window then numbers the few rows left.

Scores are integers, so the range shrinks to one value after
log(range) / log(BINS) passes, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwood.llm.common import durable, quoted, table

BLOCK, BINS = 2048, 512
#: Scores of so many cells are held at once in a task.
_CELLS = 4_000_000
#: Scaled components beyond this count as this, scores beyond a long as its ends.
_LARGEST = 1e300
_ENDS = -(2**63), 2**63 - 1


def _vectors(batch: pa.RecordBatch, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of the rows that have dim components."""
    lists = batch.column(1)
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    at = np.flatnonzero(lengths == dim)
    starts = np.cumsum(lengths) - lengths
    ids = np.asarray(batch.column(0))[at]
    return ids, _whole(scale * flat[starts[at][:, None] + np.arange(dim)])


def _whole(scaled: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(scaled), -_LARGEST, _LARGEST)


def _product(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products. Sums below 2^53 are exact in doubles; larger ones are made of Python integers."""
    if not len(vectors):
        return np.zeros((0, len(queries)), dtype=np.int64)
    if np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0) * vectors.shape[1] < 2.0**53:
        return (vectors @ queries.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    return np.minimum(np.maximum(whole(vectors) @ whole(queries).T, _ENDS[0]), _ENDS[1]).astype(np.int64)


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row ids, scores rows x queries, which of them count): a query's own row doesn't."""
    step = max(1, _CELLS // len(ids))
    for batch in batches:
        own, vectors = _vectors(batch, queries.shape[1], scale)
        for at in range(0, len(own), step):
            rows = own[at : at + step]
            yield rows, _product(vectors[at : at + step], queries), rows[:, None] != ids[None, :]


def _select_block(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, scale: float) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast((ids, queries))
    n_queries = len(ids)

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full(n_queries, np.iinfo(np.int64).max), np.full(n_queries, np.iinfo(np.int64).min), np.zeros(n_queries, dtype=np.int64)
        for _, scores, use in _scores(batches, *held.value, scale):
            low = np.minimum(low, np.where(use, scores, np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
            high = np.maximum(high, np.where(use, scores, np.iinfo(np.int64).min).max(0, initial=np.iinfo(np.int64).min))
            n += use.sum(0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(low[at]), pa.array(high[at]), pa.array(n[at])], names=["q", "low", "high", "n"])

    found = rows.mapInArrow(extent, "q bigint, low bigint, high bigint, n bigint").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toArrow()
    low, high, need = np.zeros(n_queries, dtype=np.int64), np.full(n_queries, -1, dtype=np.int64), np.zeros(n_queries, dtype=np.int64)
    at = found.column("q").to_numpy()
    low[at], high[at], need[at] = found.column("low").to_numpy(), found.column("high").to_numpy(), k
    few = at[found.column("n").to_numpy() <= k]
    high[few] = low[few]  # every row of these queries is in the result

    while np.any(high > low):
        width = np.maximum(1, ((high.astype(np.float64) - low) / (BINS - 1)).astype(np.int64) + 1)  # in doubles, as the range may pass a long's
        open_at = np.flatnonzero(high > low)
        state = sc.broadcast((open_at, low[open_at], high[open_at], width[open_at]))

        def count(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            at, low, high, width = state.value
            counts = np.zeros(len(at) * BINS, dtype=np.int64)
            own_ids, vectors = held.value
            for _, scores, use in _scores(batches, own_ids[at], vectors[at], scale):
                use &= (scores >= low) & (scores <= high)
                cells = ((scores - low).view(np.uint64) // width.astype(np.uint64)).astype(np.int64) + np.arange(len(at)) * BINS  # differences as unsigned numbers don't overflow
                counts += np.bincount(cells[use], minlength=len(counts))
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "n"])

        # At most BLOCK * BINS counts come to the driver.
        named = rows.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
        counts = np.zeros((len(open_at), BINS), dtype=np.int64)
        got = named.toArrow()
        counts.reshape(-1)[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        above = np.cumsum(counts[:, ::-1], 1)[:, ::-1]  # rows in this bin or a higher one
        pick = (above >= need[open_at][:, None]).sum(1) - 1
        more = np.where(pick + 1 < BINS, np.take_along_axis(above, np.minimum(pick + 1, BINS - 1)[:, None], 1)[:, 0], 0)
        need[open_at] -= more
        new_low = low[open_at] + pick * width[open_at]  # wraps around where the range passes a long's, and back
        rest = (high[open_at] - new_low).view(np.uint64)
        high[open_at] = new_low + np.minimum(rest, (width[open_at] - 1).astype(np.uint64)).view(np.int64)
        low[open_at] = new_low
        state.unpersist()

    edge = sc.broadcast(low)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties_q, ties_id = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        own_ids, vectors = held.value
        make = lambda q, i, s: pa.RecordBatch.from_arrays([pa.array(own_ids[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])
        for rows_at, scores, use in _scores(batches, own_ids, vectors, scale):
            r, q = np.nonzero(use & (scores > edge.value))
            yield make(q, rows_at[r], scores[r, q])
            r, q = np.nonzero(use & (scores == edge.value))
            ties_q, ties_id = np.concatenate([ties_q, q]), np.concatenate([ties_id, rows_at[r]])
            order = np.lexsort((ties_id, ties_q))
            ties_q, ties_id = ties_q[order], ties_id[order]
            first = np.searchsorted(ties_q, ties_q)  # where the query's ties begin
            few = np.arange(len(ties_q)) - first < k
            ties_q, ties_id = ties_q[few], ties_id[few]
        yield make(ties_q, ties_id, edge.value[ties_q])

    found = durable(rows.mapInArrow(keep, "query_id bigint, vec_id bigint, score bigint"))
    held.unpersist()
    edge.unpersist()
    return found


def top_k(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that meets ``queries``, the k other rows with the highest scores.

    The score is the inner product of floor(scale * component). Ties go to
    the smaller id; a query with fewer than k candidates gets all of them.
    Vectors that are null, or hold a null or a component that isn't finite,
    and rows without id take no part; vectors of another length than the query's
    aren't compared with it. Rows with a repeated id are rows of their own as candidates,
    but none is a candidate of a query with that id; of query rows that share an
    id and a length, the one with the smallest vector asks. A score that a long can't hold counts as the
    least or largest long. Other columns, whatever their names, are not read. Empty tables give an empty result.
    """
    spark = df.sparkSession
    vector = F.col(quoted(vector_col)).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(quoted(id_col)).isNotNull() & F.col(quoted(vector_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("id"), vector.alias("vector"), queries.alias("asks")).filter(F.col("vector").isNotNull() & finite)
    asking = rows.filter(F.col("asks")).withColumn("dim", F.size("vector"))
    rows = rows.select("id", "vector")
    out = None
    for dim in [r[0] for r in asking.select("dim").distinct().orderBy("dim").collect()]:
        last = None
        while True:  # blocks by id
            part = asking.filter(F.col("dim") == dim)
            part = part if last is None else part.filter(F.col("id") > last)
            got = part.select("id", "vector").orderBy("id", "vector").limit(block).collect()
            if not got:
                break
            last = got[-1][0]
            got = [r for i, r in enumerate(got) if i == 0 or r[0] != got[i - 1][0]]
            ids = np.array([r[0] for r in got], dtype=np.int64)
            vectors = _whole(scale * np.array([r[1] for r in got], dtype=np.float64).reshape(len(got), dim))
            found = _select_block(rows, ids, vectors, k, scale)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
