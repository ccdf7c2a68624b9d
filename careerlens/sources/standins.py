"""The provided test tables in the shapes of the data model.

Every adapter reads a whole table. ``SQL`` holds the same definitions for the
independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlens.functions.urls import host_of
from careerlens.sources.tables import spread

URL_ROOT = "https://jobs.example.com/"
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Landed pages with the host as site."""
    return spread(table(spark, sf, "pages"), "page_id").select("page_id", host_of(F.col("url")).alias("site"), "url", "html")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Scraped records: exact copies of a text share one url."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.col("source").alias("company"),
        F.trim("text").alias("title"),
        F.concat(F.lit(URL_ROOT), F.md5("text")).alias("url"), "text", "lang")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def scored_input(spark: SparkSession, sf: str) -> DataFrame:
    """All records with their vector, where there is one."""
    return records(spark, sf).join(vectors(spark, sf), "doc_id", "left")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """The one profile: vector 0 is the candidate's, a point lookup by key."""
    return table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding")


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses stored by earlier runs: those of records labelled good."""
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return records(spark, sf).join(good, "doc_id", "left_semi").select("url").distinct()


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Application pipeline from orders and customers."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("company"),
        F.concat(F.col("c_name"), F.lit(" "), F.col("o_orderpriority")).alias("title"),
        F.concat(F.lit(URL_ROOT), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_orderdate").cast("date").alias("date_found"),
        F.when(F.col("o_orderstatus") == "P", "Pending")
        .when(F.col("o_orderstatus") == "F", "Applied").otherwise("Interview").alias("applied_status"),
        F.col("o_orderpriority").alias("keywords_matched"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("resume_generated"),
        F.lit(None).cast("string").alias("notes"),
    )


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Run log of eight sites from the event table."""
    return table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("site"), (F.col("user_id") % 8).cast("string")).alias("company"),
        F.when(F.col("event_type") == "error", "Error").otherwise("Success").alias("status"),
        F.floor(F.col("value") / 10).cast("int").alias("postings_found"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"))


SQL = {
    "fx_pages": "select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as site, url, html from pages",
    "fx_records": (
        "select doc_id, source as company, trim(text) as title, "
        "'https://jobs.example.com/' || md5(text) as url, text, lang from documents"),
    "fx_history": (
        "select distinct 'https://jobs.example.com/' || md5(d.text) as url from documents d "
        "where d.doc_id in (select doc_id from labels where quality = 1)"),
    "fx_postings": (
        "select o.o_orderkey as id, c.c_mktsegment as company, c.c_name || ' ' || o.o_orderpriority as title, "
        "'https://jobs.example.com/' || cast(o.o_orderkey as varchar) as url, "
        "cast(o.o_orderdate as date) as date_found, "
        "case o.o_orderstatus when 'P' then 'Pending' when 'F' then 'Applied' else 'Interview' end "
        "as applied_status, o.o_orderpriority as keywords_matched, "
        "o.o_orderpriority in ('1-URGENT', '2-HIGH') as resume_generated, cast(null as varchar) as notes "
        "from orders o join customer c on o.o_custkey = c.c_custkey"),
    "fx_run_log": (
        "select event_id, ts, 'site' || cast(user_id % 8 as varchar) as company, "
        "case when event_type = 'error' then 'Error' else 'Success' end as status, "
        "cast(floor(value / 10) as int) as postings_found, "
        "case when event_type = 'error' then props end as error_message from events"),
}

