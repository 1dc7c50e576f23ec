"""Whitening against numpy over the same fit list: flat and steep spectra, odd rows, several lengths."""

import math

import numpy as np
import pytest

from boxwood.llm import whitening as W


def held_out(rows, components=16):
    """(id, component) -> (n, deviation, |whitened|, explained), one dimension."""
    x = [[math.floor(64 * np.float64(c)) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted({tuple(r) for r in x}))
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), own in zip(rows, np.array(x)):
        apart = n * own - s
        for k in range(min(components, len(s))):
            alive = values[k] > values[0] * len(s) * np.finfo(float).eps
            out.append((i, k + 1, n, sum(int(a) ** 2 for a in apart), abs(apart / n @ vectors[:, k]) / math.sqrt(values[k]) if alive else None, values[k] / values.sum()))
    return out


def compare(got, want, rel=1e-7):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4] or 0)
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"] and abs(r["whitened"]), r["explained"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g[4] is None) == (w[4] is None) and g[5] == pytest.approx(w[5], rel=1e-6, abs=1e-12)
        if g[4] is not None:
            assert g[4] == pytest.approx(w[4], rel=rel, abs=1e-6)


SCHEMA = "vec_id bigint, embedding array<double>, `vec id` int, n int"


def test_flat_spectrum_expands(spark):
    rng = np.random.default_rng(1)
    own = [(i, (rng.standard_normal(32) * np.linspace(1, 2, 32)).tolist()) for i in range(300)]
    df = spark.createDataFrame([(*r, 1, 2) for r in own], SCHEMA)
    got = W.whiten(df).collect()
    compare(got, held_out(own))
    assert max(r["identity_error"] for r in got) < 1e-9


def test_steep_spectrum_stays_small(spark):
    """Few strong directions: the random basis finds them and isn't expanded."""
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    scale = np.array([900.0, 500, 300, 150] + [0.05] * 44)
    own = [(i, ((rng.standard_normal(48) * scale) @ basis.T).tolist()) for i in range(500)]
    x = spark.createDataFrame([([math.floor(64 * c) + 1_000_000 for c in v],) for _, v in own], "x array<bigint>")
    n, sums, most = W._moments(x)[48]
    fit = W.fit_whitening(x, n, sums, most, 4, 8, 8, 0)
    assert fit.basis == 12 and fit.passes > 1 and fit.identity_error < 1e-9
    df = spark.createDataFrame([(*r, 1, 2) for r in own], SCHEMA)
    compare(W.whiten(df, components=4).collect(), held_out(own, 4))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), i * 0.5, -float(i * i % 11)]) for i in range(40)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 0.0, 0.0]), (93, [inf, 0.0, 0.0]), (94, [])]
    again = [(3, good[3][1]), (3, good[3][1]), (None, good[5][1]), (None, [9.0, 9.0, 9.0])]
    two = [(200 + i, [float(i), 1.0]) for i in range(5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in good + bad + again + two], SCHEMA)
    compare(W.whiten(df).collect(), held_out(good + again) + held_out(two))
    assert W.whiten(df.limit(0)).count() == 0
    same = W.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1, 2) for i in range(3)], SCHEMA)).collect()
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, 0.0)}


def test_large_entries(spark):
    """Sums and deviations are exact where 64 bits don't hold the steps, and end at the largest long."""
    own = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [0.0, 3.0])]
    rows = {r["vec_id"]: r for r in W.whiten(spark.createDataFrame([(*r, 1, 2) for r in own], SCHEMA)).filter("component = 1").collect()}
    assert rows[0]["deviation"] == 2**63 - 1
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in own]
    s = [sum(c) for c in zip(*x)]
    assert rows[2]["deviation"] == sum((3 * a - b) ** 2 for a, b in zip(x[2], s))


def test_registered(spark):
    import duckdb

    from boxwood.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    own = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    compare(QUERIES["op11_whitening"](spark, sf).collect(), held_out(own), rel=1e-6)
