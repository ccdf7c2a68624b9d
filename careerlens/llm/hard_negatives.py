"""Hard negatives by rotated one-bit codes with interval filters and exact integer scores.

Vectors become whole numbers, floor(256 x); the score of two of them is their inner product. A vector is rotated by a
fixed random rotation and coded by the signs of its entries, then by the signs of what is left, with half the weight each
time: ``STAGES`` one-bit codes for a row, ``ANCHOR_STAGES`` for an anchor. Code vector j is the weighted sum of the first j
sign vectors; its alignment (the multiple of it that is nearest to the vector), its norm and the norm of the residual
are stored beside the codes. Popcounts of pairs of codes give an estimate of the inner product. The residual is
orthogonal to the code vector, so by Cauchy-Schwarz the true value lies within

    |residual of the row| * |part of the anchor off the code vector| + |residual of the anchor| * |aligned code vector|

of it, a bound that holds for every pair. Stage by stage, a row stays a candidate of an anchor while its interval can
reach the scores that count: at least the k-th largest lower bound among rows that surely qualify, and the band of the
positives. Rows left after the last stage are scored with whole numbers, so the result is exact.

Anchors (ids divisible by ``EVERY``) are dealt to blocks of about ``ANCHORS_PER_BLOCK``, all rows to blocks of about
``ROWS_PER_BLOCK``, both by a hash; every pair of blocks is a group of its own, whatever labels the rows have. Each group
sends at most k rows for an anchor and positive, which are ranked over all groups. First the positives are found, then
the negatives in their bands.

Rows with a null label, a null or empty vector, or a null or non-finite entry take no part; other vectors must agree in
their number of entries, or an error tells so. Anchors that repeat with equal label and vector count once; as positives and
negatives repeated rows count each. "Other" rows of an anchor are those with another id. Rows with a null id are no
anchors and come after all ids in ties. Scores that may pass 2^62 are an error. An empty table gives an empty result.
Vectors of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlens.llm.common import columns, written

SCALE = 256
STAGES, ANCHOR_STAGES = 6, 8
#: Codes after which candidates are filtered.
FILTERED = (1, 3, 5)
ANCHORS_PER_BLOCK, ROWS_PER_BLOCK = 16_384, 8_192
EVERY, LABELS, SHIFTED = 100, 10, 7
POSITIVES, NEGATIVES = 5, 10
#: Negatives score between 30 and 90 hundredths of the positive.
BAND = (30, 90)
NO_ID = 2**63 - 1
#: Slack of every bound for rounding, relative to the product of the norms.
SLACK = 1e-9

ROW = "id long, label long, v binary, bits binary, marks binary, block int"


def rotation(d: int, seed: int = 13) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


def words(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans to rows of 64-bit words, padded with zeros."""
    n, d = signs.shape
    wide = np.zeros((n, -(-d // 64) * 64), bool)
    wide[:, :d] = signs
    return np.packbits(wide, axis=1).view(np.uint64)


def coded(x: np.ndarray, stages: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, stage, word) and marks: the vector's norm, then alignment, norm of the code vector and of the residual
    for each stage."""
    y = x.astype(float) @ rotation(x.shape[1])
    norm = np.linalg.norm(y, axis=1)
    step = (0.75 + 0.15 * stages) * norm / np.sqrt(x.shape[1])
    left, code, weight = y.copy(), np.zeros_like(y), 1.0
    bits, marks = [], [norm]
    for _ in range(stages):
        sign = np.where(left >= 0, 1.0, -1.0)
        left -= sign * step[:, None]
        code += sign * weight
        step, weight = step / 2, weight / 2
        size = np.linalg.norm(code, axis=1)
        align = (y * code).sum(axis=1) / np.maximum(size * size, 1e-300)
        bits.append(words(sign > 0))
        marks += [align, size, np.linalg.norm(y - align[:, None] * code, axis=1)]
    return np.stack(bits, axis=1), np.stack(marks, axis=1)


class Codes:
    """Unpacked rows of a group; codes and marks with a contiguous run of rows for each stage."""

    def __init__(self, frame: pd.DataFrame, stages: int):
        n = len(frame)
        self.id = frame["id"].to_numpy(np.int64)
        self.label = frame["label"].to_numpy(np.int64)
        self.v = np.frombuffer(b"".join(frame["v"]), "<i8").reshape(n, -1)
        bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(n, stages, -1)
        self.bits = np.ascontiguousarray(bits.transpose(1, 2, 0))
        marks = np.frombuffer(b"".join(frame["marks"])).reshape(n, 1 + 3 * stages).T.copy()
        self.norm, (self.align, self.size, self.rest) = marks[0], (marks[k::3] for k in (1, 2, 3))


def inner_signs(anchors: Codes, i: int, bits: np.ndarray) -> np.ndarray:
    """Inner products of anchor i's aligned code vector with sign vectors (word, row), by popcounts."""
    d, weight = anchors.v.shape[1], anchors.align[-1, i]
    out = np.zeros(bits.shape[1], np.float64)
    for code in anchors.bits[:, :, i]:
        differ = np.bitwise_count(bits[0] ^ code[0])
        if len(code) > 1:
            differ = differ.astype(np.int64)
            for mine, other in zip(bits[1:], code[1:]):
                differ += np.bitwise_count(mine ^ other)
        out += weight * d
        out -= 2 * weight * differ
        weight /= 2
    return out


def bounds(anchors: Codes, i: int, rows: Codes, at: np.ndarray, stage: int, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of anchor i's scores with the rows ``at`` from their code vectors of ``stage``; ``along`` has
    the inner products of the anchor's aligned code vector with those."""
    norm, lost = anchors.norm[i], anchors.rest[-1, i]
    align, size, rest = rows.align[stage, at], rows.size[stage, at], rows.rest[stage, at]
    sure = np.maximum(np.abs(along) / size - lost, 0)  # the anchor's least part along the code vector
    off = np.sqrt(np.maximum(norm * norm - sure * sure, 0))
    half = rest * off + lost * np.abs(align) * size + SLACK * norm * rows.norm[at]
    estimate = align * along
    return estimate - half, estimate + half


def kth_largest(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def candidates(anchors: Codes, i: int, rows: Codes, at: np.ndarray, k: int, stages: int,
               bands: list[tuple[float, float]] | None = None) -> np.ndarray:
    """The rows of ``at`` that may be among the k first of anchor i, in some band if there are bands."""
    along = np.zeros(len(at))
    for stage in range(stages):
        along += inner_signs(anchors, i, rows.bits[stage][:, at]) / 2 ** stage
        if stage not in FILTERED and stage < stages - 1:
            continue
        low, high = bounds(anchors, i, rows, at, stage, along)
        stay = np.zeros(len(at), bool)
        for least, most in bands or [(-np.inf, np.inf)]:
            sure = low[(low >= least) & (high <= most)]
            stay |= (high >= max(least, kth_largest(sure, k))) & (low <= most)
        at, along = at[stay], along[stay]
    return at


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def positives_of(anchors: Codes, rows: Codes, k: int, stages: int) -> list[tuple]:
    """(anchor row, id, score) of the first k rows of the same label."""
    out = []
    by_label = {x: np.flatnonzero(rows.label == x) for x in np.unique(anchors.label)}
    for i in range(len(anchors.id)):
        at = by_label[anchors.label[i]]
        at = candidates(anchors, i, rows, at[rows.id[at] != anchors.id[i]], k, stages)
        score = rows.v[at] @ anchors.v[i]
        out += [(i, rows.id[at[j]], score[j]) for j in first(score, rows.id[at], k)]
    return out


def negatives_of(anchors: Codes, positives: list, rows: Codes, k: int, band: tuple[int, int], stages: int) -> list[tuple]:
    """(anchor row, number of the positive, id, score) of the first k rows of other labels in each positive's band."""
    out = []
    by_label = {x: np.flatnonzero(rows.label != x) for x in np.unique(anchors.label)}
    for i, scores in enumerate(positives):
        bands = [(band[0] * s / 100, band[1] * s / 100) for s in scores if s >= 0]
        if not bands:  # below zero the band is empty
            continue
        at = candidates(anchors, i, rows, by_label[anchors.label[i]], k, stages, bands)
        score = rows.v[at] @ anchors.v[i]
        for p, s in enumerate(scores):
            # whole numbers of Python: a hundredfold score may pass a long
            least, most = -(-band[0] * int(s) // 100), band[1] * int(s) // 100
            fits = np.flatnonzero((score >= least) & (score <= most))
            for j in fits[first(score[fits], rows.id[at[fits]], k)]:
                out.append((i, p, rows.id[at[j]], score[j]))
    return out


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
           shifted: int = SHIFTED, labels: int = LABELS) -> DataFrame:
    """id (``NO_ID`` for null), label and x (whole numbers) of the rows that take part."""
    rows = columns(rows, vec_id=id_col, v=vec_col, label=label_col)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("v").cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    moved = F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), moved.alias("label"),
                       F.transform("v", lambda c: F.floor(SCALE * c)).alias("x"))


def code_table(rows: DataFrame, stages: int, block: Column) -> DataFrame:
    """Rows (id, label, x) with their codes and block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_list()).astype(np.int64)
            parts = (x.astype("<i8"), *coded(x, stages))
            out = batch[["id", "label", "block"]].copy()
            for name, part in zip(("v", "bits", "marks"), parts):
                out[name] = [p.tobytes() for p in part]
            yield out[["id", "label", "v", "bits", "marks", "block"]]

    return rows.select("id", "label", "x", block.cast("int").alias("block")).mapInPandas(run, ROW)


def ranked(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k first of each key by falling score, then id."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   band: tuple[int, int] = BAND, anchors_per_block: int = ANCHORS_PER_BLOCK,
                   rows_per_block: int = ROWS_PER_BLOCK, stages: int = STAGES,
                   anchor_stages: int = ANCHOR_STAGES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(rows, id_col, vec_col, label_col)
    is_anchor = (F.col("id") % every == 0) & (F.col("id") != NO_ID)
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("a"), F.min(F.size("x")).alias("d"),
                    F.max(F.size("x")).alias("e"),
                    F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("top")).first()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size["a"]:
        return rows.sparkSession.createDataFrame([], kind)
    if size["d"] != size["e"]:
        raise ValueError(f"vectors have {size['d']} to {size['e']} entries")
    if size["top"] >= 2.0**62:
        raise ValueError("scores may not fit a long")
    row_blocks, anchor_blocks = -(-size["n"] // rows_per_block), -(-size["a"] // anchors_per_block)

    def dealt(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", "label", "x", F.lit(seed)), F.lit(count))

    table = written(code_table(rows, stages, dealt(row_blocks, 1)), "negatives-rows")
    anchors = rows.where(is_anchor).dropDuplicates(["id", "label", "x"])
    anchors = written(code_table(anchors, anchor_stages, dealt(anchor_blocks, 2)), "negatives-anchors")

    def grid(left: DataFrame) -> tuple:
        """Anchors and rows grouped by pairs of blocks."""
        left = left.withColumn("a", F.col("block")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        right = table.withColumn("b", F.col("block")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
        return left.drop("block").groupBy("a", "b").cogroup(right.drop("block").groupBy("a", "b"))

    def first_pass(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            mine = Codes(left, anchor_stages)
            out = [(mine.id[i], mine.label[i], left["v"].iloc[i], j, s)
                   for i, j, s in positives_of(mine, Codes(right, stages), positives, stages)]
        return pd.DataFrame(out, columns=["anchor", "label", "v", "id", "score"])

    def second_pass(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            mine = Codes(left, anchor_stages)
            chosen = left["chosen"].to_list()
            scores = [[c["score"] for c in of] for of in chosen]
            found = negatives_of(mine, scores, Codes(right, stages), negatives, band, stages)
            out = [(mine.id[i], mine.label[i], left["v"].iloc[i], chosen[i][p]["place"], chosen[i][p]["id"],
                    chosen[i][p]["score"], j, s) for i, p, j, s in found]
        return pd.DataFrame(out, columns=["anchor", "label", "v", "place", "positive", "positive_score", "id", "score"])

    pairs = grid(anchors).applyInPandas(first_pass, "anchor long, label long, v binary, id long, score long")
    pairs = ranked(pairs, ["anchor", "label", "v"], positives)
    chosen = pairs.groupBy("anchor", "label", "v").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), "id", "score"))).alias("chosen"))
    with_positives = written(anchors.withColumnRenamed("id", "anchor").join(chosen, ["anchor", "label", "v"])
                             .withColumnRenamed("anchor", "id"), "negatives-positives")
    found = grid(with_positives).applyInPandas(
        second_pass, "anchor long, label long, v binary, place int, positive long, positive_score long, id long, score long")
    found = ranked(found, ["anchor", "label", "v", "place"], negatives)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(F.col("anchor").alias("anchor_id"), named("positive").alias("positive_id"), "rank",
                        named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = f"""
with r as (select vec_id as id, case when vec_id % {SHIFTED} = 0 then (label + 1) % {LABELS} else label end as label,
    list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from r where id % {EVERY} = 0),
s as (select a.id as anchor_id, r.id as id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from a join r on a.id <> r.id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= {POSITIVES})
select anchor_id, positive_id, (row_number() over w)::int as rank, s.id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same
  and {BAND[0]} * positive_score <= 100 * score and 100 * score <= {BAND[1]} * positive_score
window w as (partition by anchor_id, positive_id order by score desc, s.id)
qualify row_number() over w <= {NEGATIVES}
"""
