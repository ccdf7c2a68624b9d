"""Named queries of the operators over the given tables, and their SQL forms where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from careerlens.llm import (edit_counts, exact_dedup, fingerprints, hard_negatives, html_text, lm_score, mixing, near_dedup, packing,
                            pieces, toxicity, url_reputation, whitening)
from careerlens.llm.common import read


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"))


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = url_reputation.label_outcomes(read(spark, sf, "labels"))
    return url_reputation.url_verdicts(read(spark, sf, "pages"), outcomes)


def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf, "documents"))


def op5_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_classes(read(spark, sf, "documents"))


def op6_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(read(spark, sf, "pages"))


def op7_edit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return edit_counts.edit_counts(read(spark, sf, "documents"))


def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf, "documents"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return mixing.mix(docs, mixing.tempered_weights(docs))


def op10_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return lm_score.lm_scores(read(spark, sf, "documents"))


def op11_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(read(spark, sf, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return hard_negatives.hard_negatives(read(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_url_filter, op4_fingerprints, op5_near_dedup,
                                   op6_html_text, op7_edit_counts, op8_exact_dedup, op9_mixing, op10_lm_score,
                                   op11_pieces, op12_whitening, op13_hard_negatives)}
ORACLES = {"op3_url_filter": url_reputation.SQL, "op8_exact_dedup": exact_dedup.SQL,
           "op13_hard_negatives": hard_negatives.SQL}
