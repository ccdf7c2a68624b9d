"""MinHash fingerprints of whole texts, their likeness to edited and neighbouring texts, and similar pairs.

A fingerprint holds the least values of ``PERMUTATIONS`` universal hash functions over a text's distinct shingles of
five words, as hexadecimal text; the likeness of two fingerprints is the share of equal components. Equal texts have
equal fingerprints; texts without words share one, and their likeness is 1.

``similar_pairs`` joins bands of signatures in Spark and verifies candidates by the Jaccard similarity of the full
sets. It shares the bucket rounds with near-duplicate detection.

Null texts count as empty. Very long texts are shingled whole. Rows are ordered by descending id, null ids last, equal ids by text; the next row of the
last is the first, and a lone row is its own next. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns
from careerlens.llm.near_dedup import links_of, sketch_table
from careerlens.llm.shingles import permutations, shingles_of, signature, word_hashes, words_of

PERMUTATIONS = 64
WIDTH = 5
LOWEST = -2**63
RANGES_PER_PARTITION = 4


def signature_of(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return signature(shingles_of(word_hashes(words_of(text)), WIDTH), a, b)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float((x == y).mean())


def edited(text: str, other: str) -> str:
    """``text`` with its last third of code points replaced by as many (or all) first ones of ``other``."""
    cut = len(text) // 3
    return text[:len(text) - cut] + other[:cut]


def in_ranges(rows: DataFrame, parts: int) -> DataFrame:
    """Deal rows to ranges of ``k``, largest first, each with a guest copy of the first rows of the range after it.

    Adds ``part`` and ``guest``. Boundaries are approximate quantiles; only they and each range's largest ``k`` come
    to the driver, at most ``parts`` numbers each. Rows are then shuffled once and each range is read as a stream.
    """
    wanted = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    cuts = rows.select(F.percentile_approx("k", wanted, 10 * parts).alias("c")).first()["c"]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, k.to_numpy(np.int64), "left"), dtype="int32")

    part = F.pandas_udf(part_of, "int")
    heads = rows.select("k", part("k").alias("part")).groupBy("part").agg(F.max("k").alias("m")).collect()
    heads.sort(key=lambda r: -r["m"])
    # the first rows of a range follow the range before it; those of the first range follow the last one
    to = {r["m"]: heads[i - 1]["part"] for i, r in enumerate(heads)}

    def guest_of(k: pd.Series) -> pd.Series:
        return k.map(lambda x: [to[x]] if x in to else [])

    also = F.pandas_udf(guest_of, "array<int>")
    both = rows.withColumn("part", part("k")).withColumn("also", also("k"))
    copies = F.concat(F.array(F.struct("part", F.lit(0).alias("guest"))),
                      F.transform("also", lambda p: F.struct(p.alias("part"), F.lit(1).alias("guest"))))
    return both.select("doc_id", "text", "k", F.inline(copies))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = columns(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(LOWEST)))
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_ranges(rows, RANGES_PER_PARTITION * parts)
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("k"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = permutations(PERMUTATIONS, 4)
        held = None  # (part, guest, doc_id, text, signature) of the row before

        def line(row: tuple, after: tuple) -> tuple:
            _, _, doc_id, text, sig = row
            new = edited(text, after[3])
            sig_new = sig if new == text else signature_of(new, a, b)
            return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), sig.astype(">u4").tobytes().hex(),
                    sig_new.astype(">u4").tobytes().hex(), likeness(sig, sig_new), likeness(sig, after[4]))

        for batch in batches:
            out = []
            for part, guest, doc_id, text in zip(batch["part"], batch["guest"], batch["doc_id"], batch["text"]):
                if guest and held is not None and held[1]:
                    continue  # only the first guest is the next row
                row = (part, guest, doc_id, text, signature_of(text, a, b))
                if held is not None and not held[1]:
                    out.append(line(held, row))
                held = row
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint",
                                               "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    kind = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")
    return dealt.select("part", "guest", "doc_id", "text").mapInPandas(run, kind)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Verified links (a, b) of class representatives; equal sets of shingles form one class.

    The links connect all that is similar; within a large group of near copies they are not all of its pairs.
    """
    return links_of(sketch_table(docs, id_col, text_col), docs, id_col, text_col, threshold)[0]
