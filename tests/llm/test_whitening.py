"""Whitening against exact sums and a dense eigenvalue solver."""

import numpy as np
import pytest

from careerlens.llm import whitening
from careerlens.llm.catalog import QUERIES
from careerlens.llm.common import read

KIND = "vec_id long, embedding array<float>"


def brute(frame):
    """ids, whole vectors, n, sums, eigenvalues (falling) and eigenvectors of the covariance."""
    good = [(i, v) for i, v in frame if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    off = x - sums / n
    e, v = np.linalg.eigh(off.T @ off / n)
    return [i for i, _ in good], x, n, sums, e[::-1], v[:, ::-1]


def check(got, frame, tolerance=1e-9):
    ids, x, n, sums, e, v = brute(frame)
    k = min(8, x.shape[1])
    assert len(got) == len(ids) * k
    by = {(r["vec_id"], r["component"]): r for r in got}
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    y = (x - sums / n) @ v[:, :k] / np.sqrt(e[:k])
    mine = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((y * mine).sum(axis=0))
    assert np.abs(mine * signs - y).max() < tolerance * max(1, np.abs(y).max())
    for i, d in zip(ids, exact):
        assert by[i, 1]["deviation"] == d and by[i, 1]["n"] == n
    assert [by[ids[0], c + 1]["explained"] for c in range(k)] == pytest.approx((e / e.sum())[:k].tolist(), rel=1e-9)
    assert by[ids[0], 1]["identity_error"] < 1e-9


def test_rows(spark, sf):
    frame = [(r["vec_id"], r["embedding"]) for r in read(spark, sf, "embeddings").collect()]
    check(QUERIES["op12_whitening"](spark, sf).collect(), frame)


@pytest.mark.parametrize("fan, block", [(64, 4096), (2, 7)])
def test_factor_does_not_depend_on_blocks(spark, sf, fan, block):
    vectors = whitening.whole_vectors(read(spark, sf, "embeddings")).repartition(9)
    n, sums = whitening.exact_sums(vectors)
    r = whitening.factor(vectors, n, sums, fan, block)
    x = np.array([v["x"] for v in vectors.collect()])
    off = x - sums / n
    assert np.allclose(r.T @ r, off.T @ off, rtol=1e-12, atol=1e-9 * (off ** 2).sum())


@pytest.mark.parametrize("kind", ["random", "graded", "clustered", "equal", "short", "one"])
def test_solver(kind):
    rng = np.random.default_rng(3)
    d = {"one": 1, "short": 3}.get(kind, 40)
    values = rng.random(d) + 0.1
    if kind == "graded":
        values = 10.0 ** -np.linspace(0, 7, d)
    elif kind == "equal":
        values = np.ones(d)
    elif kind == "clustered":
        values = np.repeat([1.0, 0.5, 1e-3, 1e-4], 10) * (1 + 1e-9 * rng.random(d))
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    rows = np.linalg.qr(rng.normal(size=(d, d)))[0] @ np.diag(values) @ q.T
    a, b, v = whitening.bidiagonal(whitening.triangle(rows))
    found = whitening.dqds(a, b)
    assert found == pytest.approx(sorted(values ** 2, reverse=True), rel=1e-9, abs=1e-28)
    some, z = whitening.directions(a, b, d)
    w = v @ z
    assert np.abs(w.T @ w - np.eye(d)).max() < 1e-11
    assert np.abs(rows.T @ rows @ w - w * some).max() < 1e-13 * some[0]


def test_solver_on_a_graded_bidiagonal():
    """Tiny singular values come out with full relative accuracy, which a solver on B'B does not give."""
    a, b = 10.0 ** -np.arange(0, 12, 2), 10.0 ** -np.arange(1, 11, 2) * 0.5
    from fractions import Fraction
    product = 1.0
    for x in whitening.dqds(a, b):
        product *= x
    exact = Fraction(1)
    for x in a:
        exact *= Fraction(float(x)) ** 2
    assert product == pytest.approx(float(exact), rel=1e-13)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(np.sin(i * (j + 1))) for j in range(3)]) for i in range(50)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0]), (105, [0.0, -inf, 1.0])]
    twice = [(7, good[7][1]), (None, good[8][1])]
    frame = spark.createDataFrame(good + odd + twice, KIND)
    got = whitening.whitened(frame).collect()
    assert len(got) == 3 * 52
    ids = [(i, v) for i, v in good + [(1000, good[7][1]), (1001, good[8][1])]]
    clean = whitening.whitened(spark.createDataFrame(ids, KIND)).collect()
    check(clean, ids)
    from pyspark.sql import functions as F

    wide = frame.select("*", *[F.lit("x").alias(c) for c in ("x", "part", "r", "dim", "n", "component", "v")])
    assert len(whitening.whitened(wide).collect()) == len(got)
    assert whitening.whitened(frame.limit(0)).collect() == []
    assert whitening.whitened(frame.where("vec_id > 99")).collect() == []
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], KIND))


def test_flat_components(spark):
    """Without variance: no whitened value, no crash; one row, equal rows, a constant dimension."""
    for rows in ([(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        got = whitening.whitened(spark.createDataFrame(rows, KIND)).collect()
        assert {(r["whitened"], r["deviation"], r["identity_error"]) for r in got} == {(None, 0, None)}
    rows = [(i, [float(i), 1.0, -2.0 * i]) for i in range(9)]
    got = whitening.whitened(spark.createDataFrame(rows, KIND)).collect()
    assert {r["component"] for r in got if r["whitened"] is not None} == {1}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_large_deviations_are_exact_or_null(spark):
    rows = [(i, [float(1 << 20) * i]) for i in range(3)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(rows, KIND)).collect()}
    step = 3 * 1024 * (1 << 20)
    assert got == {0: None if step ** 2 >= 2**63 else step ** 2, 1: 0, 2: None if step ** 2 >= 2**63 else step ** 2}
