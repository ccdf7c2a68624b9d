"""Whitening of embeddings by a bidiagonal qd solver.

Components become whole numbers first, floor(1024 c) + 100000, so that counts, sums and deviations are exact. Every
partition reduces its centred rows to one triangular factor by blockwise QR; factors of ``FAN`` partitions at a time are
reduced again until ``FAN`` are left, and one factor R of the size of a vector's square comes to the driver. Householder
reflections make R bidiagonal, dqds finds the squares of its singular values to high relative accuracy, and a twisted
factorisation of the shifted matrix gives each direction; directions of close values are made orthogonal among
themselves. The singular values are those of the centred rows, so their squares over n are the eigenvalues of the
covariance, which is never formed.

Rows whose vector is null, empty, or has null or non-finite entries are dropped; other rows must agree in their number
of entries, or an error tells so. A component without variance (eigenvalue at rounding level) has a null ``whitened``.
``deviation`` is null where it does not fit a long (it grows with the square of n). Repeated rows and null ids count like
others. An empty table, or one with no usable row, gives an empty result. Vectors of any length are read whole; a task
holds one block of rows and one factor. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Factors that one task reduces to one.
FAN = 64
BLOCK_ROWS = 4096
EPS = np.finfo(float).eps
#: Eigenvalues closer than this, relatively, get directions that are made orthogonal explicitly.
CLOSE = 1e-3
LARGEST = float(2**63 - 2**11)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x: the whole numbers of the usable vectors."""
    rows = columns(rows, vec_id=id_col, v=vec_col).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    # null if some entry is null, false if some entry is not finite
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c) + SHIFT).alias("x"))


def matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_list()).astype(np.int64)


def exact_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and the sum of each dimension; a row per dimension comes to the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0
        for batch in batches:
            if len(batch):
                x = matrix(batch["x"])
                n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pd.DataFrame({"dim": np.arange(len(total)), "n": n, "s": total})

    size = vectors.select(F.size("x").alias("d")).agg(F.min("d"), F.max("d")).first()
    if size[0] is None:
        return 0, np.empty(0, np.int64)
    if size[0] != size[1]:
        raise ValueError(f"vectors have {size[0]} to {size[1]} entries")
    found = vectors.select("x").mapInPandas(run, "dim long, n long, s long")
    found = found.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return found[0]["n"], np.array([r["s"] for r in found], np.int64)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S as exact whole numbers, in floats only where a long can't hold them."""
    if float(np.abs(x).max(initial=0)) * n < LARGEST / 2:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def factor(vectors: DataFrame, n: int, sums: np.ndarray, fan: int = FAN, block: int = BLOCK_ROWS) -> np.ndarray:
    """The triangular factor of all centred rows."""
    d = len(sums)

    def folded(held: np.ndarray, rows: np.ndarray) -> np.ndarray:
        for at in range(0, len(rows), block):
            held = triangle(np.concatenate([held, rows[at:at + block]]))
        return held

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = np.empty((0, d)), None
        for batch in batches:
            if len(batch):
                part = batch["part"].iloc[0]
                held = folded(held, centred(matrix(batch["x"]), n, sums).astype(float) / n)
        if part is not None:
            yield pd.DataFrame({"part": [part], "r": [held.tobytes()]})

    def of_factors(group: pd.DataFrame) -> pd.DataFrame:
        held = np.empty((0, d))
        for raw in group.sort_values("part")["r"]:
            held = folded(held, np.frombuffer(raw).reshape(-1, d))
        return pd.DataFrame({"part": [group["part"].iloc[0]], "r": [held.tobytes()]})

    found = vectors.select(F.spark_partition_id().alias("part"), "x").mapInPandas(of_rows, "part int, r binary")
    found = written(found, "factors")
    while (count := found.count()) > fan:
        groups = found.select("part", "r", F.pmod(F.hash("part"), F.lit(-(-count // fan))).alias("g"))
        found = written(groups.groupBy("g").applyInPandas(of_factors, "part int, r binary"), "factors")
    held = np.empty((0, d))
    for row in sorted(found.collect(), key=lambda r: r["part"]):  # at most ``fan`` factors
        held = folded(held, np.frombuffer(row["r"]).reshape(-1, d))
    return np.concatenate([held, np.zeros((d - len(held), d))])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of a bidiagonal B with r = U B V', and V."""
    b, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if not size:
            return None
        u = x / size
        u[0] += 1.0 if u[0] >= 0 else -1.0
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(b[k:, k].copy())
        if u is not None:
            b[k:, k:] -= 2 * np.outer(u, u @ b[k:, k:])
        if k < d - 2:
            u = reflector(b[k, k + 1:].copy())
            if u is not None:
                b[k:, k + 1:] -= 2 * np.outer(b[k:, k + 1:] @ u, u)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(b).copy(), np.diag(b, 1).copy(), v


def dqds(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squares of the singular values of the bidiagonal matrix (a, b), largest first.

    Shifts are 1 / trace of the inverse: never above the least value, so that all quantities stay positive, and close to
    it when it stands alone. A shift that rounding makes too large is given up for a quarter of it, at last for none.
    """
    q, e = (a * a).tolist(), (b * b).tolist()
    out: list[float] = []
    sigma, tolerance = 0.0, (10 * EPS) ** 2
    while q:
        if len(q) == 1 or e[-1] <= tolerance * (sigma + q[-1]):
            out.append(sigma + q.pop())
            if e:
                e.pop()
            continue
        if min(q) <= 0:
            shift = 0.0
        else:
            inverse = total = 1 / q[0]
            for i in range(1, len(q)):
                inverse = (1 + e[i - 1] * inverse) / q[i]
                total += inverse
            shift = 1 / total * (1 - 4 * EPS * len(q))
        if sigma + shift == sigma:
            shift = 0.0
        while (got := transformed(q, e, shift)) is None:
            shift = shift / 4 if shift > EPS * sigma else 0.0
        q, e = got
        sigma += shift
    return sorted(out, reverse=True)


def transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd step; None if the shift was too large."""
    top, side = [], []
    d = q[0] - shift
    if d < 0:
        return None
    for i in range(len(e)):
        now = d + e[i]
        if now == 0:  # the matrix falls apart here
            side.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / now
            side.append(e[i] * ratio)
            d = d * ratio - shift
        if not d >= 0:
            return None
        top.append(now)
    return top + [d], side


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """The unit direction of B'B near ``value`` and the correction of the value that it suggests."""
    n = len(a)
    tiny = np.finfo(float).tiny / EPS
    down, up = np.empty(n), np.empty(n)  # s and p of the factorisations from the top and from the bottom
    lower, upper = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
    s = -value
    for i in range(n):
        down[i] = s
        if i < n - 1:
            pivot = s + a[i] * a[i]
            pivot = pivot if abs(pivot) > tiny else tiny
            lower[i] = a[i] * b[i] / pivot
            s = b[i] * b[i] * (s / pivot) - value
    p = a[-1] * a[-1] - value
    up[-1] = p
    for i in range(n - 2, -1, -1):
        pivot = b[i] * b[i] + p
        pivot = pivot if abs(pivot) > tiny else tiny
        upper[i] = a[i] * b[i] / pivot
        p = p * (a[i] * a[i] / pivot) - value
        up[i] = p
    gamma = down + up + value
    at = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(at, n - 1):
        z[i + 1] = -upper[i] * z[i]
    size = z @ z
    return z / np.sqrt(size), float(gamma[at] / size)


def directions(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of B'B and their directions as columns."""
    n = len(a)
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS * scale) + 1).tolist(), n]
    found: list[tuple[float, int, int]] = []
    for lo, hi in zip(cuts, cuts[1:]):
        found += [(v, lo, hi) for v in dqds(a[lo:hi], b[lo:hi - 1])]
    found.sort(key=lambda f: (-f[0], f[1]))
    found = found[:count]
    out = np.zeros((n, len(found)))
    rng = np.random.default_rng(1)
    for k, (value, lo, hi) in enumerate(found):
        x, y = a[lo:hi], b[lo:hi - 1]
        z, step = twisted(x, y, value)
        if abs(step) <= CLOSE * value:
            z, _ = twisted(x, y, value + step)
        near = [j for j in range(k) if found[j][1] == lo and found[j][0] - value <= CLOSE * found[0][0]]
        if near:
            # Gram-Schmidt among close values; a direction that falls into those before it is sought anew
            before = out[lo:hi, near]
            rest = z - before @ (before.T @ z)
            for _ in range(5):
                if np.linalg.norm(rest) > 0.1:
                    break
                rest = inverse_step(x, y, value, before, rng.normal(size=hi - lo))
            z = rest - before @ (before.T @ rest)
            z /= np.linalg.norm(z)
        out[lo:hi, k] = z
    return np.array([f[0] for f in found]), out


def inverse_step(a: np.ndarray, b: np.ndarray, value: float, before: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Inverse iteration on B'B - value, kept orthogonal to ``before``."""
    t = np.diag(a * a + np.append(0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    t -= (value + 4 * EPS * t.max(initial=0)) * np.eye(len(a))
    for _ in range(4):
        z = np.linalg.solve(t, z)
        z -= before @ (before.T @ z)
        z /= np.linalg.norm(z)
    return z


def fitted(vectors: DataFrame, count: int = COMPONENTS) -> dict | None:
    """n, sums, eigenvalues, share of the whole variance, and weights (dimension by component) that whiten; None without rows."""
    n, sums = exact_sums(vectors)
    if not n:
        return None
    a, b, v = bidiagonal(factor(vectors, n, sums))
    values, z = directions(a, b, min(count, len(a)))
    total = float((a * a).sum() + (b * b).sum())
    flat = values <= (8 * EPS * len(a)) ** 2 * values[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(flat, np.nan, v @ z / np.sqrt(values / n))
    return {"n": n, "sums": sums, "values": values / n, "explained": values / total if total else np.zeros(len(values)),
            "weights": weights}


def identity_error(vectors: DataFrame, fit: dict) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, from the rows themselves."""
    n, sums, weights = fit["n"], fit["sums"], fit["weights"]
    there = ~np.isnan(weights).any(axis=0)
    if not there.any():
        return None
    w = weights[:, there]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((w.shape[1] + 1, w.shape[1]))
        for batch in batches:
            if len(batch):
                y = centred(matrix(batch["x"]), n, sums).astype(float) / n @ w
                total += np.concatenate([y.T @ y, y.sum(axis=0)[None]])
        yield pd.DataFrame({"at": np.arange(total.size), "s": total.ravel()})

    sums_of = vectors.select("x").mapInPandas(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    total = np.array([r["s"] for r in sums_of.orderBy("at").collect()]).reshape(-1, w.shape[1]) / n
    cov = total[:-1] - np.outer(total[-1], total[-1])
    return float(np.abs(cov - np.eye(len(cov))).max())


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")
    vectors = whole_vectors(rows, id_col, vec_col).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fit = fitted(vectors, count)
    if fit is None:
        return rows.sparkSession.createDataFrame([], kind)
    error = identity_error(vectors, fit)
    n, sums, weights, explained = fit["n"], fit["sums"], fit["weights"], fit["explained"]
    k = len(explained)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            off = centred(matrix(batch["x"]), n, sums)
            size = (off.astype(float) ** 2).sum(axis=1)
            if size.max() < LARGEST / 2:
                deviation = pd.Series((off * off).sum(axis=1), dtype="Int64")
            else:
                exact = (off.astype(object) ** 2).sum(axis=1)
                deviation = pd.Series([int(x) if x < 2**63 else None for x in exact], dtype="Int64")
            y = off.astype(float) / n @ weights
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].astype("Int64").repeat(k).reset_index(drop=True),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)), "n": n,
                "deviation": deviation.repeat(k).reset_index(drop=True), "whitened": y.ravel(),
                "explained": np.tile(explained, len(batch)), "identity_error": np.nan if error is None else error})

    out = vectors.mapInPandas(run, kind)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("whitened", "identity_error")})
