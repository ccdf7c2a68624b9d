"""Sources: landed pages, stored tables, text files and configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlens import schemas
from careerlens.functions.urls import seen_key
from careerlens.operators.small_tables import literal_table

# ---------------------------------------------------------------------------
# Default targets, sites, boards and hiring calendar. They must
# equal the configuration of the system whose results are reproduced.
# ---------------------------------------------------------------------------

TARGETS = (
    ("Woven by Toyota", "https://woven-by-toyota.com/en/careers",
     ["New Graduate", "2026", "Software Engineer", "Graduate Engineer"], 12),
    ("Sony", "https://www.sony.com/en/SonyInfo/CorporateInfo/Careers/newgrads/",
     ["New Grad", "2026", "Graduate", "Recruiting"], 12),
    ("Rakuten", "https://global.rakuten.com/corp/careers/graduates/",
     ["New Graduate", "2026", "Graduate Recruitment"], 24),
    ("Mercari", "https://careers.mercari.com/job-categories/graduate/",
     ["New Graduate", "2026", "Graduate Program"], 24),
    ("Preferred Networks", "https://www.preferred.jp/en/news/",
     ["New Graduate", "2027", "Recruiting", "Pre-Entry"], 24),
    ("LINE Corporation", "https://linecorp.com/en/career/newgrads",
     ["New Graduate", "2026", "Fresh Graduate"], 24),
    ("DeNA", "https://dena.com/intl/recruit/",
     ["New Graduate", "2026", "Graduate Recruitment"], 24),
)

SITES = (
    ("line", "LY Corporation (LINE)",
     ["https://www.lycorp.co.jp/en/recruit/newgrads/engineer/"],
     {"title": ["h3", "p.title"]}, 3000),
    ("rakuten", "Rakuten Group",
     ["https://corp.rakuten.co.jp/careers/graduates/recruit_engineer/"], {}, 3000),
    ("mercari", "Mercari", ["https://boards.greenhouse.io/mercari"], {}, 3000),
    ("woven", "Woven by Toyota", ["https://boards.greenhouse.io/wovenbytoyota"], {}, 3000),
    ("sony", "Sony Group",
     ["https://sonyglobal.wd1.myworkdayjobs.com/en-US/SonyJapanCareers"], {}, 5000),
    ("bytedance", "ByteDance (TikTok)",
     ["https://jobs.bytedance.com/en/search?q=&limit=20&offset=0"
      "&region_ids=6666667367355156743&p_function_category_ids=6709794025192294669"], {}, 5000),
    ("toshiba", "Toshiba", ["https://hrmos.co/pages/toshiba/jobs"],
     {"job_cards": ["a.jsc-JobSearchResultItem", "a[class*='JobSearchResultItem']"]}, 5000),
    ("preferred", "Preferred Networks", ["https://www.preferred.jp/en/careers/"],
     {"job_cards": ["div.job-list-item", "a[href*='recruit']"]}, 5000),
)

BOARDS = (
    ("Japan Dev", "https://japan-dev.com/jobs/machine-learning"),
    ("TokyoDev", "https://tokyodev.com/jobs/machine-learning"),
    ("Daijob", "https://daijob.com/en/jobs/search_result?job_types[]=614"),
    ("LinkedIn", "https://www.linkedin.com/jobs/search/"
                 "?keywords=AI%20Engineer%20Japan%202026&location=Japan"),
    ("Jobs in Japan", "https://jobsinjapan.com/jobs/search?q=AI+Engineer&category=it"),
)

CALENDAR = (
    ("Mercari", "Global Hiring", "Open", "Now - May", "High"),
    ("Woven (Toyota)", "New Grad 2026", "Upcoming", "Jan 15 - Jun", "Critical"),
    ("Rakuten", "Project Crimson (India/Global)", "Upcoming", "Feb - Mar", "Critical"),
    ("Sony Group", "Global Recruitment", "Upcoming", "Mar - Apr", "Critical"),
    ("Preferred Networks", "New Graduate Hiring", "TBD", "Mar - May", "Medium"),
)

STATUS_ICONS = (("Open", "🟢"), ("Upcoming", "🟡"))
OTHER_ICON = "🔴"
# ------------------------------- end of fixed values ------------------------


def _ddl(name: str) -> str:
    # StructType -> DDL text for literal_table
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in getattr(schemas, name))


def targets(spark: SparkSession, rows=TARGETS) -> DataFrame:
    """Monitored sites with their keywords and check interval."""
    return literal_table(spark, rows, _ddl("TARGETS"))


def boards(spark: SparkSession, keywords, rows=BOARDS, hours: int = 24) -> DataFrame:
    """Aggregator boards in the shape of targets."""
    return literal_table(spark, [(n, u, list(keywords), hours) for n, u in rows], _ddl("TARGETS"))


def all_targets(spark: SparkSession, board_keywords, with_boards: bool = True) -> DataFrame:
    """Targets, and boards when asked for, marked by ``source_kind``."""
    out = targets(spark).withColumn("source_kind", F.lit("generic"))
    if with_boards:
        out = out.unionByName(boards(spark, board_keywords).withColumn("source_kind", F.lit("board")))
    return out


def sites(spark: SparkSession, rows=SITES) -> DataFrame:
    """Sites with extraction rules; ``url`` is the first of their addresses."""
    # a map column does not pass through pandas: send key/value rows, build it here
    flat = [(k, n, u, [{"role": r, "css": c} for r, c in sel.items()], w) for k, n, u, sel, w in rows]
    df = literal_table(
        spark, flat,
        "site_key string, name string, urls array<string>, "
        "sel array<struct<role:string,css:array<string>>>, wait_time int")
    return df.select(
        "site_key", "name", "urls", F.element_at("urls", 1).alias("url"),
        F.map_from_entries("sel").alias("selectors"), "wait_time")


def calendar(spark: SparkSession, rows=CALENDAR) -> DataFrame:
    """Hiring calendar with the icon of each state."""
    df = literal_table(spark, rows, _ddl("CALENDAR"))
    icon = F.lit(OTHER_ICON)
    for state, sign in reversed(STATUS_ICONS):
        icon = F.when(F.col("status") == state, F.lit(sign)).otherwise(icon)
    return df.withColumn("icon", icon)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores.

    A few large row groups would otherwise keep all text work in a few tasks.
    Scans with enough splits, as on large inputs, are returned untouched.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages (url and source) in place of a fetch."""
    return spread(spark.read.schema(schemas.PAGES).parquet(path), "page_id")


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def seen_keys(postings: DataFrame) -> DataFrame:
    """Keys of all stored addresses, the build side of the seen filter."""
    return postings.select(seen_key(F.col("url")).alias("seen_key")).distinct()


def read_description(spark: SparkSession, path: str) -> DataFrame:
    """Description files, one row and one text each."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("description"))
