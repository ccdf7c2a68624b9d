"""Hard negatives against a plain loop over all pairs; the intervals against the true scores."""

import numpy as np
import pytest

from careerlens.llm import hard_negatives
from careerlens.llm.hard_negatives import Codes, bounds, candidates, coded

KIND = "vec_id long, embedding array<float>, label int"


def brute(frame, every=100, positives=5, negatives=10):
    rows = []
    for i, v, label in frame:
        if label is None or v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        rows.append((i, label, tuple(int(c) for c in np.floor(256 * np.array(v, np.float32).astype(float)))))
    out = []
    rank = lambda some: sorted(some, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for i, label, x in sorted({r for r in rows if r[0] is not None and r[0] % every == 0}):
        scored = [(j, sum(a * b for a, b in zip(x, y)), of == label) for j, of, y in rows if j != i]
        others = rank([(j, s) for j, s, same in scored if not same])
        for j, s in rank([(j, s) for j, s, same in scored if same])[:positives]:
            band = [o for o in others if 30 * s <= 100 * o[1] <= 90 * s][:negatives]
            out += [(i, j, k + 1, o[0], s, o[1]) for k, o in enumerate(band)]
    return sorted(out, key=repr)


def drawn(n, d, spread, seed=0, step=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + spread * rng.normal(size=d)
        rows.append((i * step, [float(c) for c in (v / np.linalg.norm(v)).astype(np.float32)], int(rng.integers(10))))
    return rows


@pytest.mark.parametrize("n, d, spread", [(300, 64, 0.3), (300, 5, 2.0), (200, 70, 0.05), (40, 1, 1.0)])
@pytest.mark.parametrize("blocks", [(16_384, 8_192), (7, 33)])
def test_brute(spark, n, d, spread, blocks):
    frame = drawn(n, d, spread)
    got = hard_negatives.hard_negatives(spark.createDataFrame(frame, KIND), anchors_per_block=blocks[0], rows_per_block=blocks[1])
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(frame) and (got or d == 1)


def unpacked(x, stages):
    import pandas as pd

    parts = coded(x, stages)
    frame = pd.DataFrame({"id": range(len(x)), "label": 0, "v": [r.astype("<i8").tobytes() for r in x]})
    for name, part in zip(("bits", "marks"), parts):
        frame[name] = [p.tobytes() for p in part]
    return Codes(frame, stages)


@pytest.mark.parametrize("d", [1, 3, 64, 100])
def test_intervals_hold(d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(300, d)) * 50, rng.normal(size=(50, d)) * 50 + 200, np.zeros((2, d)), np.eye(d)[:1] * 256])
    x = np.floor(x).astype(np.int64)
    rows, anchors = unpacked(x, 6), unpacked(x[::20], 8)
    every = np.arange(len(x))
    survivors = 0
    for i in range(len(anchors.id)):
        truth = x @ anchors.v[i]
        along, widths = np.zeros(len(x)), []
        for stage in range(6):
            along += hard_negatives.inner_signs(anchors, i, rows.bits[stage]) / 2 ** stage
            low, high = bounds(anchors, i, rows, every, stage, along)
            assert (low <= truth).all() and (truth <= high).all()
            widths.append((high - low).mean())
        assert d < 3 or widths[-1] < widths[0] / 5
        best = candidates(anchors, i, rows, every, 10, 6)
        assert set(np.flatnonzero(truth > np.sort(truth)[-10])) <= set(best)
        survivors += len(best)
    assert d < 3 or survivors < 0.3 * len(x) * len(anchors.id)


def test_odd_rows(spark):
    nan = float("nan")
    frame = [r for r in drawn(60, 4, 1.0)]
    odd = [(100, None, 1), (200, [1.0, 0.0, 0.0, 0.0], None), (300, [nan, 0.0, 0.0, 0.0], 1), (300, [None, 0.0, 0.0, 0.0], 1),
           (300, [], 2), (None, [0.5, 0.5, 0.5, 0.5], 3), (None, frame[3][1], 4)]
    rows = frame + odd + [(5001, frame[0][1], 2), (5002, frame[0][1], 2), (5003, frame[0][1], 2)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, KIND))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)
    twice = frame + [frame[10]]  # an anchor that repeats counts once as an anchor, twice as another's row
    got = hard_negatives.hard_negatives(spark.createDataFrame(twice, KIND))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(twice)
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(frame, KIND)
    wide = plain.select("*", *[F.lit("x").alias(c) for c in ("id", "x", "v", "block", "a", "b", "score", "rank")])
    assert hard_negatives.hard_negatives(wide).count() == hard_negatives.hard_negatives(plain).count()
    assert hard_negatives.hard_negatives(plain.limit(0)).collect() == []
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0, 2.0], 1)], KIND))
