"""Whitening against the eigenvectors of numpy, and spectrum slicing on matrices with known spectra."""

import numpy as np

from patchlake.llm import whitening

SCHEMA = "id long, vector array<float>, n int, w string"


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    m = (q * np.array(values, float)) @ q.T
    return (m + m.T) / 2


def test_counts_of_eigenvalues():
    r = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 30):
        m = r.standard_normal((d, d))
        m = m + m.T
        eigen = np.linalg.eigvalsh(m)
        for shift in [*(eigen[:-1] + eigen[1:]) / 2, eigen[0] - 1, eigen[-1] + 1, 0.0]:
            assert whitening.above(m, shift) == (eigen > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # needs a pair of pivots


def test_leading():
    for values in ([9, 7, 5, 3, 1], [5, 5, 5, 2, 2, 1, 0, 0], [1, 1 - 1e-9, 0.5, 1e-6], [3], [4, 0, 0]):
        m = spectrum(values)
        found, vectors = whitening.leading(m, 8)
        want = [v for v in values if v > 0]
        assert len(found) == len(want) and np.allclose(found, want, rtol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-13)
        assert np.allclose(m @ vectors, vectors * found, atol=1e-13 * max(values) * 10)
    assert whitening.leading(np.zeros((3, 3)), 8)[0].size == 0


def test_whitened(spark):
    r = np.random.default_rng(5)
    vectors = (r.standard_normal((400, 12)) * np.linspace(1, 3, 12) + r.standard_normal(12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5, rows[5][1]), (None, rows[7][1])]  # a repeated row, a null id
    bad = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [1.0] * 11 + [None]), (904, [float("inf")] * 12), (905, [1.0] * 5), (906, [1e30] * 12)]
    made = whitening.whitened(spark.createDataFrame([(*x, 1, "z") for x in rows + bad], SCHEMA), "id", "vector", 8)
    assert made.columns == ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = made.collect()
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 1024).astype(np.int64) + 100000
    n, sums = len(x), x.sum(0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = (x - sums / n) @ axes / np.sqrt(values)
    assert len(out) == n * 8 and {o.n for o in out} == {n} and {o.identity_error for o in out}.pop() < 1e-10
    deviation = {k: ((n * v.astype(object) - sums) ** 2).sum() for (k, _), v in zip(rows, x)}
    at = {k: i for i, (k, _) in enumerate(rows)}
    signs = [np.sign(axes[np.abs(axes[:, j]).argmax(), j]) for j in range(8)]
    for o in out:
        j = o.component - 1
        assert int(o.deviation) == deviation[o.key]
        assert abs(o.whitened - want[at[o.key], j] * signs[j]) < 1e-9
        assert abs(o.explained / (values[j] / np.trace(np.cov(x.T, bias=True))) - 1) < 1e-9


def test_no_variance_and_far_values(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, "")] * 3, SCHEMA)
    assert whitening.whitened(one, "id", "vector").count() == 0
    assert whitening.whitened(one.limit(0), "id", "vector").count() == 0
    far = spark.createDataFrame([(1, [1e15, 0.0], 0, ""), (2, [-1e15, 0.0], 0, "")], SCHEMA)
    out = whitening.whitened(far, "id", "vector").collect()
    x = [int(np.float32(v)) * 1024 + 100000 for v in (1e15, -1e15)]
    assert [(o.component, round(abs(o.whitened), 9)) for o in out] == [(1, 1.0)] * 2
    assert {int(o.deviation) for o in out} == {(2 * x[0] - sum(x)) ** 2}
