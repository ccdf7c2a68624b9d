"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by length and a hash of their first characters, then by a hash of the full content.
Each step looks only at groups that the step before left with more than one row. The scan turns every text into its
length, prefix hash and content hash, which the result carries anyway; from there on rows of some 60 bytes are written
and moved, and never a text. Groups are counted by aggregation, so that a length, or a group of copies, that holds a
third of all rows is combined before the shuffle; survivors meet the list of groups in a join of its own, whose hot
partition can be split.

Nulls count as empty texts. Empty texts are equal to each other. Very long texts are hashed whole. Of equal rows the
largest id stays; null ids come last. Rows repeated with one id form a group like others, and all of its rows with the
kept id stay: such rows cannot be told apart. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns, written

PREFIX_CHARS = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, prefix, content (SHA-256) of every row, written once."""
    rows = columns(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.select("doc_id", F.octet_length("text").alias("n_bytes"),
                               F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"),
                               F.sha2("text", 256).alias("content")), "digests")


def exact_groups(rows: DataFrame) -> DataFrame:
    """Groups of more than one equal text of :func:`digests`: n_bytes, content, keep_id, group_size."""
    # counted by length and prefix first: a common length comes to its count as one row a prefix and task
    heads = rows.groupBy("n_bytes", "prefix").agg(F.count("*").alias("_n"))
    lengths = heads.groupBy("n_bytes").agg(F.sum("_n").alias("_m")).where("_m > 1").select("n_bytes")
    heads = heads.where("_n > 1").join(lengths, "n_bytes", "left_semi").select("n_bytes", "prefix")
    left = rows.join(written(heads, "heads"), ["n_bytes", "prefix"], "left_semi")
    full = left.groupBy("n_bytes", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return full.where("group_size > 1")


def marked(rows: DataFrame) -> DataFrame:
    """Rows of :func:`digests` with keep_id, group_size and kept."""
    joined = rows.join(written(exact_groups(rows), "groups"), ["n_bytes", "content"], "left")
    return joined.select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True)
        .otherwise(F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).alias("kept"),
        F.col("content").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    return marked(digests(docs, id_col, text_col))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each set of equal texts one row with the largest id.

    What goes is written as ids and content hashes; with its size known it is sent to the rows where it is small, and
    texts are moved only where it is not. Rows that repeat an id with the same text are reduced to one: only such rows, if
    there are any, are compared with each other.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = digests(docs, id_col, text_col)
    gone = written(marked(found).where("not kept").select(
        F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone")).distinct(), "gone")
    again = written(found.groupBy("doc_id", "content").agg(F.count("*").alias("n")).where("n > 1")
                    .select(F.col("doc_id").alias("again_id"), F.col("content").alias("again")), "again")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.sha2(text, 256).alias("content"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("content") == F.col("gone")), "left_anti")
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again_id")) & (F.col("content") == F.col("again"))
        rows = rows.join(again, same, "left_anti").unionByName(
            rows.join(again, same, "left_semi").dropDuplicates(["id", "content"]))
    return rows.select("row.*")


SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
