"""The corpus pipeline: toxicity, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the folder of
``spark.checkpoint.dir`` and reads back as the next stage's documents. All stages but the last keep the columns of
documents, others included. Nulls, empty and very long texts, ties and repeated rows go as each stage's module says; texts
are read whole. An empty table gives an empty result. The mixture is the order of the rows: files and rows within them follow the schedule.
It adds the positions as a last column, by which the packing numbers the sequences and deals pieces of one length to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from careerlens.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from careerlens.llm.common import free_name, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. The classifier learns from the documents' training fold."""
    return toxicity.clean_rows(docs, read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, with the least id."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture, with their positions in it."""
    return mixing.mixed_rows(docs, mixing.tempered_weights(docs), position_col=free_name(docs, "mixture_position"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset. Sequences follow the last column, the mixture's position."""
    return packing.pack_documents(docs, order_col=docs.columns[-1])


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_sequences)]
#: SQL can't train the classifier, shingle near copies or tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
