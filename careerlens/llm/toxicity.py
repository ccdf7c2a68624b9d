"""Toxicity scores by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts (positives) and texts of unknown kind (unlabelled); clean labels are not used but
for the class prior. With class prior p the risk of a classifier g is

    p * R_P(+1) + max(0, R_U(-1) - p * R_P(-1))

with the sigmoid loss, where R_P and R_U are means over positives and unlabelled texts: the second term estimates the
risk on clean texts and may not fall below zero. When it does in a batch, the step goes against its gradient, so that
the classifier forgets what it overfitted. Several linear classifiers are trained in numpy from different seeds and
their logits averaged.

A text's features are those of its distinct words: the word and its first four and five letters, lower-cased and
without punctuation at the ends. Only features that occur in at least ``MIN_POSITIVES`` positives, and there at least
``MIN_RATIO`` times as often as in the unlabelled texts, are used, at most ``MAX_FEATURES`` by that ratio.

The classifiers are fitted on bounded samples (``POSITIVES``, ``UNLABELLED`` rows in expectation), drawn by a hash of
the id over all rows of the training fold. Every whole text is scored. Null and empty texts get the score of a text without features. Rows
with a null id are scored and never trained on; rows repeated with one id are scored each, and their label is the
largest. An empty table gives an empty result; without any positive all scores are 0, and a sample that is empty though
there are rows is an error. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns, crc_of, worker_cache, written

FOLDS, HELD_OUT = 3, 1
POSITIVES, UNLABELLED = 3000, 9000
MIN_POSITIVES, MIN_RATIO, MAX_FEATURES = 4, 2.5, 1024
CUT = 0.7
SEEDS = (1, 2, 3)
#: Words whose features a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 200_000
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¿¡"


def features_of(word: str) -> tuple[str, ...]:
    """Names of the features of one blank-delimited, lower-cased word."""
    word = word.strip(EDGES)
    if not word:
        return ()
    return ("w" + word, "4" + word[:4], "5" + word[:5]) if len(word) > 5 else ("w" + word, "4" + word[:4])


def text_features(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in features_of(w)}


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, p, u: how many sampled positives and unlabelled texts have it. sample: text, positive."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for positive, part in batch.groupby("positive"):
                seen = Counter()
                for text in part["text"]:
                    seen.update(text_features(text or ""))
                yield pd.DataFrame({"feature": list(seen), "n": list(seen.values()), "positive": positive})

    found = sample.mapInPandas(run, "feature string, n long, positive boolean")
    return found.groupBy("feature").agg(F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("p"),
                                        F.sum(F.when(F.col("positive"), 0).otherwise(F.col("n"))).alias("u"))


def select_features(sample: DataFrame) -> list[str]:
    """Features that are clearly more frequent in positives, by ratio, then name."""
    size = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_p, n_u = max(1, size.get(True, 0)), max(1, size.get(False, 0))
    ratio = (F.col("p") / n_p) / ((F.col("u") + 1) / n_u)
    good = feature_counts(sample).where(F.col("p") >= MIN_POSITIVES).withColumn("ratio", ratio)
    good = good.where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("ratio"), "feature").limit(MAX_FEATURES)
    return [r["feature"] for r in good.collect()]


def sampled_hits(sample: DataFrame, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrices of the sampled positives and unlabelled texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [sorted(index[f] for f in text_features(t or "") if f in index) for t in batch["text"]]
            yield pd.DataFrame({"positive": batch["positive"], "hits": hits})

    rows = sample.mapInPandas(run, "positive boolean, hits array<int>").collect()
    rows.sort(key=lambda r: tuple(r["hits"]))
    return tuple(design([r["hits"] for r in rows if r["positive"] == kind], len(index)) for kind in (True, False))


def design(texts: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.float32)
    for i, found in enumerate(texts):
        out[i, found] = 1
    return out


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk on toxic and on clean texts, and their gradients, of weights ``w`` with the bias last."""
    def slope(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        """Mean sigmoid loss 1 / (1 + exp(sign * g)) and its gradient."""
        loss = 1 / (1 + np.exp(np.clip(sign * (x @ w[:-1] + w[-1]), -50, 50)))
        g = -sign * loss * (1 - loss) / len(x)
        return float(loss.mean()), np.append(x.T @ g, g.sum())

    r_pp, up = slope(positive, +1)
    r_pn, down_p = slope(positive, -1)
    r_u, down_u = slope(unlabelled, -1)
    return prior * r_pp, r_u - prior * r_pn, prior * up, down_u - prior * down_p


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, epochs: int = 30, batch: int = 256,
             rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by Adam on the non-negative risk estimate.

    Weights stay at zero or above: every feature was selected as more frequent in positives.
    """
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w = np.append(rng.normal(0, 0.01, d), -2.0)
    m, v, step = np.zeros(d + 1), np.zeros(d + 1), 0
    share = len(positive) / max(1, len(unlabelled))

    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            u = unlabelled[order[at:at + batch]]
            p = positive[rng.integers(0, len(positive), max(32, min(len(positive), round(len(u) * share))))]
            _, clean, up, down = risk(w, p, u, prior)
            gradient = up + down if clean >= 0 else -down
            gradient[:-1] += decay * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient ** 2
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            np.maximum(w[:-1], 0, out=w[:-1])
    return w[:-1], float(w[-1])


def hash_limit(share: float) -> int:
    """The 64-bit hash below which this share of all hashes lies, to a part in 2^53."""
    return -2**63 + min(2**64 - 1, int(min(1.0, share) * 2**64))


def of_hash(share: float):
    """Condition that holds for this share of all ids, by a hash."""
    return F.lit(True) if share >= 1 else F.xxhash64("doc_id", F.lit(11)) < F.lit(hash_limit(share))


def sample_of(texts: DataFrame, known: DataFrame, toxic: int, rows: int, positives: int = POSITIVES,
              unlabelled: int = UNLABELLED) -> DataFrame:
    """text, positive of the sampled rows of ``texts``; ``toxic`` and ``rows`` are the numbers that are drawn from.

    ``known`` has doc_id and toxic. A sample without positives or without unlabelled texts is an error: a classifier of
    nothing would pass every text.
    """
    # bounded by the sample's size: cut by the hash before it is sent
    confirmed = known.where("toxic = 1").where(of_hash(positives / toxic)).select("doc_id")
    sample = texts.join(F.broadcast(confirmed), "doc_id", "left_semi").withColumn("positive", F.lit(True)).unionByName(
        texts.where(of_hash(unlabelled / rows)).withColumn("positive", F.lit(False)))
    sample = written(sample.dropDuplicates(["doc_id", "positive"]).select("text", "positive"), "toxicity-sample")
    kinds = {r["positive"] for r in sample.select("positive").distinct().collect()}
    if kinds != {True, False}:
        raise ValueError(f"no {'positive' if True not in kinds else 'unlabelled'} texts in a sample of {rows} rows, {toxic} of them toxic")
    return sample


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict[str, float]:
    """Feature weights, with the bias under ''. docs: doc_id, text; labels: doc_id, toxic; only training rows are read."""
    fold = F.col("doc_id").isNotNull() & (F.pmod(crc_of("doc_id"), F.lit(FOLDS)) != HELD_OUT)
    known = labels.where(fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    counts = known.agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic")).first()
    if not counts["toxic"]:
        return {}
    prior = counts["toxic"] / counts["n"]
    texts = docs.where(fold)
    # labels of documents that are not there teach nothing, and must not thin out the sample
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    rows, toxic = texts.count(), known.where("toxic = 1").count()
    if not rows or not toxic:
        return {}
    sample = sample_of(texts, known, toxic, rows, positives, unlabelled)
    names = select_features(sample)
    x_p, x_u = sampled_hits(sample, {f: i for i, f in enumerate(names)})
    fits = [fit_nnpu(x_p, x_u, prior, seed) for seed in SEEDS]
    weights = np.mean([w for w, _ in fits], axis=0)
    return {"": float(np.mean([b for _, b in fits])), **{f: float(x) for f, x in zip(names, weights)}}


def scorer(weights: dict[str, float]):
    """A function from whole text to score; to be called in a task. ``weights`` is bounded by MAX_FEATURES."""
    cache = worker_cache(f"toxicity-{zlib.crc32(repr(sorted(weights.items())).encode())}")
    bias = weights.get("", -50.0)

    def hits(word: str) -> tuple[str, ...]:
        got = cache.get(word)
        if got is None:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            got = cache[word] = tuple(f for f in features_of(word) if f in weights)
        return got

    def one(text: str | None) -> float:
        found = {f for w in set((text or "").lower().split()) for f in hits(w)}
        logit = bias + sum(weights[f] for f in sorted(found))
        return 1 / (1 + float(np.exp(-np.clip(logit, -50, 50))))

    return one


def score(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = scorer(weights)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"],
                                "score": [one(t) for t in batch["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       (F.pmod(crc_of("doc_id"), F.lit(FOLDS)) == HELD_OUT).alias("held_out"))
    got = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    docs = columns(docs, doc_id=id_col, text=text_col)
    labels = columns(labels, doc_id=id_col, toxic=label_col)
    return score(docs, train(docs, labels))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass over the texts."""
    weights = train(columns(docs, doc_id=id_col, text=text_col), columns(labels, doc_id=id_col, toxic="toxic"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = scorer(weights)
        for texts in batches:
            yield pd.Series([one(t) >= CUT for t in texts], dtype=bool)

    toxic = F.pandas_udf(run, "boolean")
    return docs.where(~toxic(F.col(f"`{text_col}`")))
