"""Reports over postings and run logs. Each is one pass with partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------- pipeline

# The nine columns of the pipeline view.
FEED_COLUMNS = ("id", "company", "title", "date_found", "url", "applied_status",
                "keywords_matched", "resume_generated", "notes")


def feed(postings: DataFrame) -> DataFrame:
    """Pipeline view, newest first (url breaks ties)."""
    return newest_first(postings.select(*FEED_COLUMNS))


def newest_first(postings: DataFrame) -> DataFrame:
    return postings.orderBy(F.desc("date_found"), "url")


def recent(postings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest postings: a top-k per task, merged, no full sort."""
    return newest_first(postings).limit(n)


def kpis(postings: DataFrame) -> DataFrame:
    def in_state(s: str) -> Column:
        return F.count_if(F.col("applied_status") == s)

    return postings.agg(
        F.count("*").alias("total"),
        in_state("Pending").alias("pending"),
        in_state("Applied").alias("applied"),
        in_state("Interview").alias("interview"),
        F.count_if(F.col("resume_generated")).alias("resume_ready"),
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, largest first, value as tie-break."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def per_day(postings: DataFrame, column: str = "date_found") -> DataFrame:
    return postings.groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("n")).orderBy("day")


def options(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a filter column."""
    return df.select(column).distinct().orderBy(column)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def by_ids(postings: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Batch point lookup: the postings named by a list of ids."""
    return postings.join(ids.select(key), key, "left_semi")


def missing_ids(postings: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids that do not exist; a caller treats any row as an error."""
    return ids.select(key).distinct().join(postings.select(key), key, "left_anti")


def require_posting(postings: DataFrame, posting_id) -> DataFrame:
    """One posting by id; raises when it is not there."""
    found = postings.filter(F.col("id") == posting_id)
    if found.isEmpty():
        raise ValueError(f"no posting with id {posting_id}")
    return found


# --------------------------------------------------------------- run health

def last_run(run_log: DataFrame) -> DataFrame:
    """The latest run overall."""
    return run_log.orderBy(F.desc("ts"), "company").limit(1)


def last_run_per_site(run_log: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("status", "postings_found"), F.struct("ts", "postings_found", "status")).alias("__r")
    return run_log.groupBy("company").agg(F.max("ts").alias("ts"), latest).select("company", "ts", "__r.*")


def run_metrics(run_log: DataFrame) -> DataFrame:
    """Runs, successes, failures and findings per company and overall.

    Findings count on successful runs only. The overall row has ``company`` NULL
    and ``scope`` 'all'.
    """
    ok = F.col("status") == "Success"
    return run_log.rollup("company").agg(
        F.grouping("company").alias("__g"),
        F.count("*").alias("runs"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.coalesce(F.sum(F.when(ok, F.col("postings_found"))), F.lit(0)).cast("bigint").alias("found"),
    ).select(
        F.when(F.col("__g") == 1, "all").otherwise("company").alias("scope"),
        "company", "runs", "successes", "failures", "found",
        F.coalesce(F.try_divide(F.col("successes"), F.col("runs")), F.lit(0.0)).alias("success_rate"),
    )


def success_rate(run_log: DataFrame) -> DataFrame:
    """Share of successful runs, 0 when there was none."""
    ok = F.count_if(F.col("status") == "Success")
    return run_log.agg(F.coalesce(F.try_divide(ok, F.count("*")), F.lit(0.0)).alias("success_rate"))


def health_rows(checks: DataFrame) -> DataFrame:
    """PASS with findings, WARN without, FAIL on an error."""
    status = (F.when(F.col("error").isNotNull(), "FAIL")
              .when(F.col("postings_found") > 0, "PASS").otherwise("WARN"))
    found = F.when(F.col("error").isNotNull(), 0).otherwise(F.coalesce("postings_found", F.lit(0)))
    return checks.withColumns({"status": status, "postings_found": found})


def _health_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.coalesce(F.sum("postings_found"), F.lit(0)).cast("bigint").alias("found"),
    )


def health_report(rows: DataFrame) -> DataFrame:
    """Count and percent per status, all three always present, plus all findings."""
    counts = _health_counts(rows)
    each = F.array(*[
        F.struct(F.lit(s).alias("status"), F.col(c).alias("n"))
        for s, c in (("PASS", "passed"), ("WARN", "warned"), ("FAIL", "failed"))
    ])
    flat = counts.select("total", "found", F.inline(each))
    percent = F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0))
    return flat.select("status", "n", percent.alias("percent"), "total", "found")


def health_verdict(rows: DataFrame) -> DataFrame:
    verdict = (F.when(F.col("failed") > 0, "attention")
               .when(F.col("warned") > 0, "healthy").otherwise("operational"))
    return _health_counts(rows).select("total", "passed", "warned", "failed", "found", verdict.alias("verdict"))


# -------------------------------------------------------- large previews

#: 2^SKETCH_BITS registers: a relative error of about 1.04 / sqrt(2^bits), some 0.8 %.
SKETCH_BITS = 14


def daily_sketches(postings: DataFrame, *columns: str, day: str = "date_found", bits: int = SKETCH_BITS) -> DataFrame:
    """(day, n, one sketch per column): what a day's rows add to counts of distinct values; written once per day."""
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(c) for c in columns]
    return postings.groupBy(F.to_date(day).alias("day")).agg(F.count("*").alias("n"), *sketches)


def merged_sketches(sketches: DataFrame, *columns: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sketches of several days as one per group of ``keys``; the postings themselves are not read."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.hll_union_agg(c, True).alias(c) for c in columns])


def distinct_preview(sketches: DataFrame, *columns: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows and about how many distinct values each column has, from daily sketches."""
    merged = merged_sketches(sketches, *columns, keys=keys)
    return merged.select(*keys, "n", *[F.hll_sketch_estimate(c).alias(c) for c in columns])


def save_summary(tagged: DataFrame) -> DataFrame:
    """Matches, newly inserted ones and duplicates of a run."""
    return tagged.agg(
        F.count("*").alias("matches"),
        F.count_if("is_new").alias("added"),
        F.count_if(~F.col("is_new")).alias("duplicates"),
    )


def batch_quality(tagged: DataFrame, url: str = "url") -> DataFrame:
    """Records scraped, valid unique ones, and the difference, per company.

    Distinct urls are counted in two plain aggregations, so a hot url collapses
    before the shuffle.
    """
    valid = F.col("reject_reason").isNull()
    per_url = tagged.groupBy("company", F.when(valid, F.col(url)).alias("__u")).agg(F.count("*").alias("__n"))
    return per_url.groupBy("company").agg(
        F.sum("__n").alias("scraped"), F.count("__u").alias("kept"),
    ).withColumn("filtered", F.col("scraped") - F.col("kept"))


def pair_with_counts(sites: DataFrame, records: DataFrame, key: str = "company") -> DataFrame:
    """Every site with its number of records, 0 for those without any."""
    counts = records.groupBy(key).agg(F.count("*").alias("n"))
    return sites.join(counts, key, "left").fillna(0, ["n"])


def due_targets(targets: DataFrame, run_log: DataFrame, as_of: Column) -> DataFrame:
    """Targets never run, or whose interval has passed since their last run."""
    last = run_log.groupBy("company").agg(F.max("ts").alias("last_run"))
    joined = targets.join(last, "company", "left")
    due_at = F.col("last_run") + F.make_dt_interval(hours=F.col("check_interval_hours"))
    return joined.withColumn("due_at", due_at).filter(F.col("last_run").isNull() | (F.col("due_at") <= as_of))
