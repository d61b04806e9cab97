from __future__ import annotations

import math

import numpy as np
import pytest

from menuspark.llm import whitening as wh


def _table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash") for i, v in vectors], "vec_id long, embedding array<float>, x string")


def _longs(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def test_equals_dense_eigenvectors(spark, sf_dir):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    dim = len(vectors[0][1])
    odd = [(-1, None), (-2, [math.nan] + [0.0] * (dim - 1)), (-3, [math.inf] + [0.0] * (dim - 1)), (-4, [None] + [0.0] * (dim - 1)), (-5, []), (-6, [1.0]), (None, [0.5] * dim), (0, vectors[0][1])]
    got = wh.whitened_components(_table(spark, vectors + odd)).collect()
    kept = vectors + odd[-2:]
    x = np.array([_longs(v) for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:32], turn[:, ::-1][:, :32]
    want = centred @ turn / np.sqrt(values)
    rows = {}
    for r in got:
        rows.setdefault(r["id"], []).append(r)
    assert len(got) == 32 * n and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    signs = {}
    for (i, _), w, deviation in zip(kept, want, np.square(n * x - sums).sum(axis=1), strict=True):
        if i == 0:
            continue
        for r in rows[i]:
            k = r["component"] - 1
            sign = signs.setdefault(k, np.sign(r["whitened"] * w[k]))
            assert abs(sign * r["whitened"] - w[k]) < 1e-7 and r["deviation"] == deviation
            assert r["explained"] == pytest.approx(values[k] / np.trace(centred.T @ centred / n), rel=1e-9)


@pytest.mark.parametrize("d, wanted, decay", [(150, 10, 0.97), (40, 32, 0.8), (300, 4, 0.995)])
def test_jacobi_davidson_reaches_double_precision(d, wanted, decay):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = decay ** np.arange(d) * 7
    matrix = (q * values) @ q.T
    found, vectors, residual = wh.leading(lambda w: matrix @ w, d, wanted)
    assert np.allclose(found, values[:wanted], rtol=1e-12) and residual < 1e-11
    assert np.abs(np.abs(np.sum(vectors * q[:, :wanted], axis=0)) - 1).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    matrix = (q * np.linspace(-3, 5, 30)) @ q.T
    b = np.hstack([rng.standard_normal((30, 3)), np.zeros((30, 1))])
    assert np.abs(matrix @ wh.minres(lambda z: matrix @ z, b, 60) - b).max() < 1e-8


def test_degenerate_tables(spark):
    few = wh.whitened_components(_table(spark, [(1, [1, 2, 3]), (1, [1, 2, 3]), (2, [4, 2, 1])])).collect()
    assert len(few) == 9
    for r in few:
        assert (r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-12 and r["n"] == 3
    assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in wh.whitened_components(_table(spark, [(1, [2, 3])])).collect())
    for table in (_table(spark, []), _table(spark, [(1, None), (2, [])])):
        assert wh.whitened_components(table).collect() == []


def test_deviations_are_exact_or_null():
    x = np.array([[10**12, 5], [-(10**12), 7], [0, 0]])
    n, sums = 3, x.sum(axis=0)
    want = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert wh._deviations(x, n, sums) == [w if w < 1 << 63 else None for w in want]
    assert wh._deviations(x // 10**5, n, sums // 10**5) == [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums // 10**5, strict=True)) for row in x // 10**5]
