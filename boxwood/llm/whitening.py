"""Embedding whitening by a randomised range finder.

Vectors become integers, and each distinct integer vector is written once: the
fit list. Its length n and its sums S are exact. Every product with the
covariance V is a pass over all rows of the list, centred before multiplying:
a row gives y = (n*x - S) / n, and a task gives the sums of y (y'Q), which is
as many numbers as Q has.

Q begins as a random basis of ``components`` + ``oversample`` directions. A
pass gives VQ; Rayleigh-Ritz on Q'VQ gives eigenvalues, vectors and, as VQ is
known, the residual of each. If those are not at rounding error, VQ is
orthogonalised to be the next Q. Where the residuals fall too slowly to get
there in ``passes`` passes, as they do on flat spectra, Q expands to the full
dimension, in which one pass is exact.

The driver holds matrices of the dimension's size, never rows.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwood.llm.common import durable, quoted, table

#: Scaled entries beyond this count as this; sums of squares beyond a long count as the largest long.
_LARGEST = 2.0**62
_LONG = 2**63 - 1
#: Residuals up to so many units of rounding of the largest eigenvalue are rounding errors.
_UNITS = 64


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def _apart(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n*x - S, exact: as int64 if that holds it, else as Python integers."""
    if n * (2 * largest + 1) < _LONG:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _moments(fit: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """By dimension: the number of rows, the sum of each entry, the largest entry's size."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            lengths = np.asarray(batch.column(0).value_lengths())
            for dim in np.unique(lengths):
                x = _matrix(batch.column(0).filter(pa.array(lengths == dim)), int(dim))
                n, sums, most = held.get(int(dim), (0, [0] * int(dim), 0))
                most = max(most, int(np.abs(x).max(initial=0)))
                own = x.sum(0).tolist() if len(x) * most < _LONG else x.astype(object).sum(0).tolist()
                held[int(dim)] = [n + len(x), [a + b for a, b in zip(sums, own, strict=True)], most]
        rows = [(dim, j, n, decimal.Decimal(s), most) for dim, (n, sums, most) in held.items() for j, s in enumerate(sums)]
        kinds = {"dim": pa.int32(), "j": pa.int32(), "n": pa.int64(), "s": pa.decimal128(38, 0), "most": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, kinds.values())], names=list(kinds))

    rows = fit.mapInArrow(partial, "dim int, j int, n bigint, s decimal(38,0), most bigint").groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("most").alias("most")).collect()
    out: dict[int, tuple[int, list[int], int]] = {}
    for r in rows:
        n, sums, most = out.get(r["dim"], (r["n"], [0] * r["dim"], 0))
        sums[r["j"]] = int(r["s"])
        out[r["dim"]] = (n, sums, max(most, r["most"]))
    return out


@dataclass
class Whitening:
    """What the fit list says of the vectors of one dimension."""

    n: int
    sums: list[int]
    largest: int
    vectors: np.ndarray  # dimension x components
    values: np.ndarray
    trace: float
    basis: int  # directions in the basis that the components come from
    passes: int
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def spread(self) -> np.ndarray:
        """sqrt of the eigenvalues; nan where nothing but rounding is left."""
        floor = self.values.max(initial=0.0) * self.dim * np.finfo(float).eps
        return np.sqrt(np.where(self.values > floor, self.values, np.nan))

    def project(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(np.float64) / self.n) @ self.vectors / self.spread()


def _summed(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], dim: int) -> np.ndarray:
    """The sum over all rows (one int64 vector each) of what of_batch gives for a batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_matrix(batch.column(0), dim))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["cell", "v"])

    got = rows.mapInArrow(partial, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[got.column("cell").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(shape)


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling Ritz values, their vectors, and the residuals' lengths."""
    inner = q.T @ vq
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(vq @ turn - vectors * values, axis=0)


def fit_whitening(rows: DataFrame, n: int, sums: list[int], largest: int, components: int, oversample: int, passes: int, seed: int) -> Whitening:
    """rows: the fit list's vectors x (array<bigint>), all of one dimension."""
    dim, keep = len(sums), min(components, len(sums))

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """VQ and V's trace."""

        def of_batch(x: np.ndarray) -> np.ndarray:
            y = _apart(x, n, sums, largest).astype(np.float64) / n
            return np.column_stack([y.T @ (y @ q), (y * y).sum(0)])

        total = _summed(rows, of_batch, (dim, q.shape[1] + 1), dim) / n
        return total[:, :-1], float(total[:, -1].sum())

    width = min(dim, components + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0] if width < dim else np.eye(dim)
    last, done = None, 0
    while True:
        vq, trace = times(q)
        done += 1
        values, vectors, residuals = _ritz(q, vq)
        allowed = _UNITS * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
        worst = float(residuals[:keep].max(initial=0.0))
        if q.shape[1] == dim or worst <= allowed:
            break
        falls = last is None or worst < last and np.log(allowed / worst) / np.log(worst / last) <= passes - done
        last = worst
        q = np.linalg.qr(vq)[0] if falls and done < passes else np.eye(dim)
    out = Whitening(n, sums, largest, vectors[:, :keep], np.maximum(values[:keep], 0.0), trace, q.shape[1], done)
    alive = np.isfinite(out.spread())

    def covariance(x: np.ndarray) -> np.ndarray:
        w = out.project(_apart(x, n, sums, largest))[:, alive]
        return w.T @ w

    if alive.any():
        got = _summed(rows, covariance, (int(alive.sum()),) * 2, dim) / n
        out.identity_error = float(np.abs(got - np.eye(len(got))).max())
    return out


_RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, components: int = 16, oversample: int = 8, passes: int = 8, seed: int = 0) -> DataFrame:
    """A row for each row of df with a vector, and each component up to ``components`` or the dimension.

    Vectors that are null, or hold a null or an entry that isn't finite, are
    dropped, as are empty ones, which have no components. Vectors of different
    lengths are fitted apart, each length as a table of its own. Repeated rows
    count once in the fit and each get their rows; null ids stay. A component
    without variance has null as whitened (as if all vectors are equal), and explained
    is null if nothing varies; such components don't count for identity_error. Entries
    beyond 2^62 count as that, deviations beyond a long as the largest long. Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    vector = F.col(quoted(vector_col)).cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * F.lit(scale), F.lit(_LARGEST)), F.lit(-_LARGEST))).cast("long") + F.lit(offset))
    rows = df.filter(F.col(quoted(vector_col)).isNotNull() & finite & (F.size(vector) > 0)).select(F.col(quoted(id_col)).alias("id"), whole.alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    fit = durable(rows.select("x").distinct())
    fitted = {}
    for dim, (n, sums, most) in _moments(fit).items():
        fitted[dim] = fit_whitening(fit.filter(F.size("x") == dim), n, sums, most, components, oversample, passes, seed)
    held = spark.sparkContext.broadcast(fitted)  # matrices of the dimension's size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", *(x.split()[0] for x in _RESULT.split(", "))]
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                fit = held.value[int(dim)]
                apart = _apart(_matrix(batch.column(1).take(pa.array(at)), int(dim)), fit.n, fit.sums, fit.largest)
                short = apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * int(dim) < _LONG
                squares = (apart * apart).sum(1) if short else np.array([min(sum(int(v) ** 2 for v in row), _LONG) for row in apart], dtype=np.int64)
                w, k = fit.project(apart), fit.vectors.shape[1]
                column = w.reshape(-1)
                explained = np.tile(fit.values / fit.trace, len(at)) if fit.trace > 0 else np.full(len(column), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(column), fit.n)), pa.array(np.repeat(squares, k)), pa.array(column, mask=np.isnan(column)), pa.array(explained, mask=np.isnan(explained)), pa.array(np.full(len(column), fit.identity_error))],
                    names=names,
                )

    return rows.mapInArrow(apply, f"id {kind}, {_RESULT}").withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
