"""The postings table and its changes.

Layout under a shared root::

    <root>/postings/version=<n>/found_day=<date>/run_id=<id>/*.parquet   bucketed by url
    <root>/filter/run_id=<id>/*.parquet                                  Bloom filter of the stored urls, by words
    <root>/edits/edit_run=<id>/*.parquet                                 edit log, bucketed by url
    <root>/run_log/run_id=<id>/*.parquet
    <root>/alerts/run_id=<id>/*.parquet

Postings and edits are written in ``BUCKETS`` files by a hash of the url, which Spark knows when it reads them: joins on
the url move the other side only. A run's urls first meet the filter, a table of at most ``FILTER_WORDS`` rows whatever
the history; only possible hits meet the history itself.

A run owns its ``run_id`` directories and replaces them, and the history it is compared with leaves that run out.
Repeating a run after a lost executor or driver therefore gives the same table. An edit writes nothing but its log,
which is resolved at read, so a repeated run keeps edits. Retention drops whole days. ``rewrite`` writes a next
version, which counts once its ``_SUCCESS`` marker is there.
"""

from __future__ import annotations

import hashlib

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlens import schemas
from careerlens.functions.urls import posting_id
from careerlens.lexicon import RETENTION_DAYS
from careerlens.operators.dedup import dedup_by_url, drop_known_urls

BUCKETS = 16
#: 64-bit words of the Bloom filter: some 6 urls a word give one false hit in 40.
FILTER_WORDS = 1 << 22
EDITED = ("applied_status", "notes", "resume_generated")
NO_DAY = "1970-01-01"


# ------------------------------------------------------ DataFrame operators

def new_rows(batch: DataFrame, history: DataFrame, order, url: str = "url") -> DataFrame:
    """Insert-if-absent: the first row per url that history does not hold."""
    return drop_known_urls(dedup_by_url(batch, order, url), history, url)


def tag_new(batch: DataFrame, history: DataFrame, order, url: str = "url") -> DataFrame:
    """Every row of ``batch`` with ``is_new``: true for the rows that get inserted.

    A left join with the inserted rows' positions; ``order`` must be unique.
    """
    keys = [c if isinstance(c, str) else None for c in order]
    if None in keys:
        raise ValueError("tag_new needs column names that identify a row")
    fresh = new_rows(batch.select(url, *keys), history, order, url).select(*keys, F.lit(True).alias("__new"))
    return batch.join(fresh, keys, "left").withColumn(
        "is_new", F.coalesce("__new", F.lit(False))).drop("__new")


def as_postings(rows: DataFrame, found: Column, matched: Column | None = None,
                score: Column | None = None, notes: Column | None = None, carry=()) -> DataFrame:
    """Shape inserted rows as postings in their initial state.

    ``carry`` names further columns to keep behind the posting's own.
    """
    def given(c, kind):
        return (F.lit(None) if c is None else c).cast(kind)

    body = F.col("text") if "text" in rows.columns else F.lit(None)
    return rows.select(
        posting_id(F.col("company"), F.col("url")).alias("id"),
        "company", "title", "url",
        given(matched, "array<string>").alias("matched_keywords"),
        given(score, "double").alias("match_score"),
        found.cast("timestamp").alias("date_found"),
        F.lit("Pending").alias("applied_status"),
        given(notes, "string").alias("notes"),
        body.cast("string").alias("description"),
        F.lit(False).alias("resume_generated"),
        *carry,
    )


def rendered_keywords(matched: Column, score: Column) -> Column:
    """The one text column both scans write: keyword list, else the score."""
    return F.when(F.size(matched) > 0, F.array_join(matched, ", ")).otherwise(
        F.format_string("Semantic Match: %.2f", score))


def score_notes(score: Column, snippet: Column) -> Column:
    return F.concat(F.format_string("AI-matched. Score: %.2f", score), F.lit("\n"), snippet)


def apply_edits(base: DataFrame, edits: DataFrame, key: str = "id",
                columns=("applied_status", "notes", "resume_generated")) -> DataFrame:
    """Keyed update of the given columns, NULLs included; unknown keys are ignored.

    The last edit per key wins when ``edits`` carries ``edit_no``, otherwise keys
    must be unique.
    """
    if "edit_no" in edits.columns:
        latest = F.max_by(F.struct(*columns), F.col("edit_no")).alias("__e")
        edits = edits.groupBy(key).agg(latest).select(key, "__e.*")
    marked = edits.select(key, F.struct(*columns).alias("__edit"))
    joined = base.join(marked, key, "left")
    hit = F.col("__edit").isNotNull()
    return joined.withColumns({
        c: F.when(hit, F.col("__edit").getField(c)).otherwise(F.col(c)) for c in columns
    }).select(*base.columns)


def retention_cutoff(as_of: Column, days: int = RETENTION_DAYS) -> Column:
    """Start of the UTC day ``days`` before ``as_of``."""
    return F.date_sub(F.to_date(as_of), days)


def retain(postings: DataFrame, as_of: Column, days: int = RETENTION_DAYS,
           column: str = "date_found") -> DataFrame:
    """Rows found on or after the cutoff; rows without a date are kept."""
    old = F.col(column) < retention_cutoff(as_of, days)
    return postings.filter(~F.coalesce(old, F.lit(False)))


def expired(postings: DataFrame, as_of: Column, days: int = RETENTION_DAYS,
            column: str = "date_found") -> DataFrame:
    return postings.filter(F.col(column) < retention_cutoff(as_of, days))


def alert_messages(inserted: DataFrame, found: Column, keywords: str = "matched_keywords") -> DataFrame:
    """One message per inserted row."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"**{label}:** "), value)

    # fixed text: the heading and labels of the message
    message = F.concat_ws(
        "\n",
        F.lit("🚨 **NEW JOB MATCH FOUND!**"),
        line("Company", F.col("company")),
        line("Keywords", F.array_join(keywords, ", ")),
        line("Title", F.col("title")),
        line("URL", F.col("url")),
        line("Found", F.date_format(found, "yyyy-MM-dd HH:mm:ss")),
    )
    return inserted.select("company", "url", message.alias("message"))


# -------------------------------------------------------------- written form

def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _children(spark: SparkSession, path: str) -> list[str]:
    p = _path(spark, path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []


def _exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current_version(spark: SparkSession, root: str) -> int:
    """Highest complete version of the postings table; 0 before the first one."""
    table = f"{root}/postings"
    numbers = [int(n.split("=")[1]) for n in _children(spark, table) if n.startswith("version=")]
    done = [n for n in numbers if _exists(spark, f"{table}/version={n}/_SUCCESS")]
    return max(done, default=0)


def _version_path(spark: SparkSession, root: str) -> str:
    return f"{root}/postings/version={current_version(spark, root)}"


def _delete(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _table(spark: SparkSession, path: str, columns: str, partitions: str, key: str = "url") -> str:
    """A catalog name for a folder of Parquet files bucketed by ``key``; partitions are found by listing."""
    name = "careerlens_" + hashlib.md5(f"{path}|{BUCKETS}".encode()).hexdigest()
    if spark.catalog.tableExists(name):
        spark.catalog.refreshTable(name)
        return name
    setting = "spark.sql.hive.manageFilesourcePartitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        by = f"partitioned by ({partitions})" if partitions else ""
        quoted = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"create table {name} ({columns}) using parquet {by} clustered by ({key}) into {BUCKETS} buckets "
                  f"location '{quoted}'")
    finally:
        spark.conf.set(setting, before)
    return name


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _write_bucketed(df: DataFrame, path: str, partitions: tuple[str, ...], mode: str = "append", key: str = "url") -> None:
    """Write into a folder bucketed by ``key``: one file per bucket and partition.

    The shuffle is that of the buckets, so a day that holds most rows is written by as many tasks as there are buckets.
    """
    spark = df.sparkSession
    kinds = {f.name: f for f in df.schema}
    name = _table(spark, path, _ddl(df.schema), ", ".join(partitions), key)
    given = [c for c in kinds if c not in partitions]
    rows = df.select(*given, *partitions).repartition(BUCKETS, key)
    rows.write.insertInto(name, overwrite=mode == "overwrite")
    spark.catalog.refreshTable(name)


def _postings_table(spark: SparkSession, root: str) -> str:
    return _table(spark, _version_path(spark, root), f"{_ddl(schemas.POSTINGS)}, found_day date, run_id string",
                  "found_day, run_id")


def stored_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings as they were inserted, with ``run_id`` and ``found_day``; edits are not in them."""
    path = _version_path(spark, root)
    schema = schemas.POSTINGS.add("run_id", "string").add("found_day", "date")
    if not any(n.startswith("found_day=") for n in _children(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.table(_postings_table(spark, root)).select(*schema.names)


_EDIT_KIND = "url string, id string, edit_no bigint, applied_status string, notes string, resume_generated boolean"


def _edit_log(spark: SparkSession, root: str) -> DataFrame | None:
    path = f"{root}/edits"
    if not any(n.startswith("edit_run=") for n in _children(spark, path)):
        return None
    return spark.read.table(_table(spark, path, f"{_EDIT_KIND}, edit_run string", "edit_run"))


def latest_edits(spark: SparkSession, root: str) -> DataFrame | None:
    """The last edit of each url, or None without any. The log's buckets are those of the groups."""
    log = _edit_log(spark, root)
    if log is None:
        return None
    last = F.max_by(F.struct("id", *EDITED), F.struct("edit_no", "edit_run"))
    return log.groupBy("url").agg(last.alias("__edit"))


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    """All postings with their last edits, ``run_id`` and ``found_day``.

    Postings and edits lie in the same buckets of the url: neither side moves.
    """
    base = stored_postings(spark, root)
    edits = latest_edits(spark, root)
    if edits is None:
        return base
    joined = base.join(edits, "url", "left")
    hit = F.col("__edit.id") == F.col("id")
    return joined.withColumns({
        c: F.when(hit, F.col("__edit").getField(c)).otherwise(F.col(c)) for c in EDITED}).select(*base.columns)


def record_edits(spark: SparkSession, root: str, edits: DataFrame, edit_run: str) -> None:
    """Append keyed edits to the log: (id, [edit_no,] applied_status, notes, resume_generated), NULLs included.

    Of several edits of an id the largest ``edit_no`` wins, over all logs; without it the time of the call counts.
    Ids that are not stored are ignored. Repeating a call with the same ``edit_run`` replaces its rows.
    """
    if "edit_no" not in edits.columns:
        edits = edits.withColumn("edit_no", F.unix_micros(F.current_timestamp()))
    given = edits.select("id", F.col("edit_no").cast("bigint").alias("edit_no"), *EDITED)
    rows = stored_postings(spark, root).select("url", "id").join(given, "id")
    _delete(spark, f"{root}/edits/edit_run={edit_run}")
    _write_bucketed(rows.select("url", "id", "edit_no", *EDITED, F.lit(edit_run).alias("edit_run")),
                    f"{root}/edits", ("edit_run",))


def compact_edits(spark: SparkSession, root: str, edit_run: str) -> None:
    """Fold the log into one entry per url, under ``edit_run``; postings are not touched."""
    log = _edit_log(spark, root)
    if log is None:
        return
    old = [n for n in _children(spark, f"{root}/edits") if n.startswith("edit_run=") and n != f"edit_run={edit_run}"]
    last = log.groupBy("url").agg(F.max_by(F.struct("id", "edit_no", *EDITED), F.struct("edit_no", "edit_run")).alias("e"))
    _write_bucketed(last.select("url", "e.*", F.lit(edit_run).alias("edit_run")), f"{root}/edits", ("edit_run",))
    for name in old:  # entries that are still there beside their fold change nothing
        _delete(spark, f"{root}/edits/{name}")


# ------------------------------------------------------------ the url filter

def _filter_bits(url: Column | str, words: int) -> tuple[Column, Column]:
    """Word and mask of a url: four bits of one 64-bit word."""
    h = F.xxhash64(url, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(4):
        place = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return F.pmod(F.xxhash64(url), F.lit(words)), mask


def filter_rows(urls: DataFrame, url: str = "url", words: int = FILTER_WORDS) -> DataFrame:
    """(word, bits) of the urls' Bloom filter; at most ``words`` rows."""
    word, mask = _filter_bits(url, words)
    return urls.select(word.alias("word"), mask.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def possible_hits(urls: DataFrame, filters: DataFrame, url: str = "url", words: int = FILTER_WORDS) -> DataFrame:
    """Rows of ``urls`` whose url may be in the filter: all stored ones, and few others."""
    word, mask = _filter_bits(url, words)
    every = filters.groupBy("word").agg(F.bit_or("bits").alias("__bits")).withColumnRenamed("word", "__word")
    marked = urls.withColumn("__w", word).withColumn("__m", mask)
    hit = (F.col("__w") == F.col("__word")) & (F.col("__bits").bitwiseAND(F.col("__m")) == F.col("__m"))
    return marked.join(every, hit, "left_semi").drop("__w", "__m")


def _filters(spark: SparkSession, root: str, run_id: str) -> DataFrame | None:
    """Filter words of all runs but ``run_id``."""
    path = f"{root}/filter"
    names = [n for n in _children(spark, path) if n.startswith("run_id=") and n != f"run_id={run_id}"]
    if not names:
        return None
    return spark.read.schema("word bigint, bits bigint").parquet(*[f"{path}/{n}" for n in names])


def drop_stored(spark: SparkSession, root: str, rows: DataFrame, run_id: str, name: str = "rows") -> DataFrame:
    """Rows whose url no other run has stored: the seen filter of a scan, by the filter and the buckets of the history."""
    known = known_urls(spark, root, rows, run_id, name)
    return rows if known is None else rows.join(known, "url", "left_anti")


def known_urls(spark: SparkSession, root: str, batch: DataFrame, run_id: str, name: str = "batch") -> DataFrame | None:
    """Urls of ``batch`` that other runs stored; None if there is none.

    What passes the filter is written apart, so its size is known when it meets the history. The history is read by
    buckets of the url or against a broadcast list; it is never shuffled.
    """
    filters = _filters(spark, root, run_id)
    if filters is None:
        return None
    path = f"{root}/possible/run_id={run_id}/{name}"
    possible_hits(batch.select("url"), filters).write.mode("overwrite").parquet(path)
    possible = spark.read.schema("url string").parquet(path)
    if possible.isEmpty():
        return None
    history = stored_postings(spark, root).where(F.col("run_id") != run_id).select("url")
    return history.join(possible, "url", "left_semi")


def insert_run(spark: SparkSession, root: str, postings: DataFrame, run_id: str) -> DataFrame:
    """Insert-if-absent a run's postings; returns the rows this run inserted.

    ``postings`` must have the postings columns and hold each url once (see :func:`new_rows`).
    """
    return insert_counted(spark, root, postings, run_id)[0]


def insert_counted(spark: SparkSession, root: str, postings: DataFrame, run_id: str) -> tuple[DataFrame, dict[str, int]]:
    """As :func:`insert_run`, with the numbers of ``matches`` (rows given), ``added`` and ``duplicates``.

    Given rows are counted as they are kept for the write, added ones from the footers of the run's files. A write observes
    nothing where a plan turns out to be empty, so its observations do not do."""
    day = F.coalesce(F.to_date("date_found"), F.lit(NO_DAY).cast("date"))
    # read three times: for the filter, to write and to count. A lost block is recomputed.
    batch = postings.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = known_urls(spark, root, batch, run_id)
        # the filter first, of all that is given: a url that is stored is always in it
        filter_rows(batch).write.mode("overwrite").parquet(f"{root}/filter/run_id={run_id}")
        fresh = batch if known is None else batch.join(known, "url", "left_anti")
        fresh = fresh.select(*schemas.POSTINGS.names, day.alias("found_day"), F.lit(run_id).alias("run_id"))
        path = _version_path(spark, root)
        for name in _children(spark, path):
            if name.startswith("found_day="):
                _delete(spark, f"{path}/{name}/run_id={run_id}")
        _write_bucketed(fresh, path, ("found_day", "run_id"))
        matches = batch.count()
    finally:
        batch.unpersist()
        _delete(spark, f"{root}/possible/run_id={run_id}")
    added = stored_postings(spark, root).where(F.col("run_id") == run_id).count()
    return inserted_by(spark, root, run_id), {"matches": matches, "added": added, "duplicates": matches - added}


def inserted_by(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return read_postings(spark, root).filter(F.col("run_id") == run_id)


def drop_expired(spark: SparkSession, root: str, as_of: Column, days: int = RETENTION_DAYS) -> int:
    """Delete the days before the cutoff and return how many postings they held.

    The count comes from the files' footers and the rest from names: no data is read or copied. Postings without a date
    stay. Urls of dropped days may come back; the filter still takes them for possible hits, which the history denies.
    """
    path = _version_path(spark, root)
    cutoff = spark.range(1).select(retention_cutoff(as_of, days).cast("string")).first()[0]
    old = [n for n in _children(spark, path) if n.startswith("found_day=") and NO_DAY != n.split("=")[1] < cutoff]
    if not old:
        return 0
    count = spark.read.schema(schemas.POSTINGS).parquet(*[f"{path}/{n}" for n in old]).count()
    for name in old:
        _delete(spark, f"{path}/{name}")
    return count


def rewrite(spark: SparkSession, root: str, changed: DataFrame) -> int:
    """Write ``changed`` (a whole table) as the next version and switch to it."""
    number = current_version(spark, root) + 1
    target = f"{root}/postings/version={number}"
    day = F.coalesce("found_day", F.lit(NO_DAY).cast("date"))
    _write_bucketed(changed.select(*schemas.POSTINGS.names, day.alias("found_day"), "run_id"), target, ("found_day", "run_id"))
    filter_rows(changed).write.mode("overwrite").parquet(f"{root}/filter/run_id=version-{number}")
    marker = _path(spark, f"{target}/_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, True).close()
    return number


def log_runs(runs: DataFrame, root: str, run_id: str) -> None:
    """Write the run-log rows of one run."""
    runs.select(*schemas.RUN_LOG.names).write.mode("overwrite").parquet(f"{root}/run_log/run_id={run_id}")


def read_run_log(spark: SparkSession, root: str) -> DataFrame:
    schema = schemas.RUN_LOG.add("run_id", "string")
    if not _children(spark, f"{root}/run_log"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/run_log")


def write_alerts(alerts: DataFrame, root: str, run_id: str) -> None:
    alerts.write.mode("overwrite").parquet(f"{root}/alerts/run_id={run_id}")


def export_view(df: DataFrame) -> DataFrame:
    """Columns as they go into a text file: lists are rendered."""
    return df.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


# Blanks stay, and an empty text differs from a null, which is written as NULL_MARK.
NULL_MARK = "\\N"
CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": NULL_MARK}


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header and RFC quoting."""
    (export_view(df).write.mode("overwrite").option("header", True)
     .options(**CSV_OPTIONS).csv(path))


def read_csv_export(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .options(**CSV_OPTIONS).csv(path))


def save_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
