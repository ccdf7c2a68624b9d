"""Streams against their batch twins, replays and state."""

import datetime as dt

from pyspark.sql import functions as F

from careerlens.lexicon import LinkPolicy
from careerlens.operators import store
from careerlens.plans import keyword_scan
from careerlens.sources import standins as fx
from careerlens.streaming import intake, refetch
from careerlens.streaming.daily import daily_counts

AT = "2024-02-01 08:00:00"


def _targets(pages):
    return pages.select("site").distinct().select(
        "site", F.col("site").alias("company"), F.array(F.lit("The"), F.lit("ich"), F.lit("que")).alias("keywords"))


def _land(spark, sf, path, files=4):
    fx.pages(spark, sf).select("page_id", "site", "url", "html").repartition(files).write.mode("overwrite").parquet(path)


def test_intake_equals_batch_and_is_incremental(spark, sf, tmp_path, rows):
    land, root, ck = (str(tmp_path / n) for n in ("land", "root", "ck"))
    _land(spark, sf, land)
    pages = fx.pages(spark, sf)
    scan = intake.keyword_scan_of(_targets(pages), LinkPolicy(min_text=3))
    schema = spark.read.parquet(land).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(land)
        q = intake.start_intake(stream, root, scan, found=F.to_timestamp(F.lit(AT)), checkpoint=ck)
        q.awaitTermination()

    run()
    twin = scan(pages)
    got = store.read_postings(spark, root)
    assert rows(got, "url") == rows(twin.select("url").distinct())
    assert got.select("run_id").distinct().count() == 2
    assert spark.read.parquet(f"{root}/alerts").count() == got.count()
    log = store.read_run_log(spark, root)
    assert log.agg(F.sum("postings_found")).first()[0] == got.count()
    # every landed site is logged, also those without a match
    assert log.select("company").distinct().count() == pages.select("site").distinct().count()
    # nothing new landed: nothing changes
    before = got.count()
    run()
    assert store.read_postings(spark, root).count() == before
    # the same pages land again: all of it is known
    fx.pages(spark, sf).select("page_id", "site", "url", "html").write.mode("append").parquet(land)
    run()
    assert store.read_postings(spark, root).count() == before


def test_repeated_batch_replaces_itself(spark, sf, tmp_path, rows):
    root = str(tmp_path / "root")
    pages = fx.pages(spark, sf)
    scan = intake.keyword_scan_of(_targets(pages), LinkPolicy(min_text=3), context=False)
    found = F.to_timestamp(F.lit(AT))
    intake.process_batch(pages, "r-1", root, scan, found)
    first = rows(store.read_postings(spark, root), "url", "run_id")
    alerts = rows(spark.read.parquet(f"{root}/alerts"))
    # a lost driver repeats the batch a day later
    intake.process_batch(pages, "r-1", root, scan, F.to_timestamp(F.lit("2024-02-02 09:00:00")))
    assert rows(store.read_postings(spark, root), "url", "run_id") == first
    assert len(rows(spark.read.parquet(f"{root}/alerts"))) == len(alerts) == len(first)
    intake.process_batch(pages, "r-2", root, scan, found)
    assert store.inserted_by(spark, root, "r-2").count() == 0


def test_run_log_names_companies_and_failures(spark, sf, tmp_path):
    root = str(tmp_path / "root")
    page = '<a href="/jobs/1">The Graduate Engineer</a>'
    pages = spark.createDataFrame(
        [(1, "a.example.com", "https://a.example.com/x", page, None),
         (2, "b.example.com", "https://b.example.com/x", None, "HTTP 503"),
         (3, "c.example.com", "https://c.example.com/x", "<p>none</p>", None)],
        "page_id bigint, site string, url string, html string, fetch_error string")
    targets = spark.createDataFrame(
        [("a.example.com", "Company A"), ("b.example.com", "Company B"), ("c.example.com", "Company C"),
         ("d.example.com", "Company D")], "site string, company string")
    scan = intake.keyword_scan_of(targets.withColumn("keywords", F.array(F.lit("Graduate"))), LinkPolicy(min_text=3))
    found = F.to_timestamp(F.lit(AT))
    intake.process_batch(pages, "r-1", root, scan, found, targets)
    log = store.read_run_log(spark, root).select("company", "status", "postings_found", "error_message").collect()
    assert sorted(map(tuple, log)) == [
        ("Company A", "Success", 1, None), ("Company B", "Error", 0, "HTTP 503"), ("Company C", "Success", 0, None),
        ("Company D", "Error", 0, "no page landed")]
    part = keyword_scan.run_rows(targets, keyword_scan.fetch_outcomes(pages), store.read_postings(spark, root), found)
    assert part.filter("company = 'Company D'").count() == 0


def test_native_and_context_scan_agree_on_plain_pages(spark, sf, rows):
    pages = fx.pages(spark, sf)
    mine = keyword_scan.pages_of_targets(pages.withColumnRenamed("url", "page_url"), _targets(pages))
    policy = LinkPolicy(min_text=3)
    a = rows(keyword_scan.native_matches(mine, policy))
    assert a and a == rows(keyword_scan.context_matches(mine, policy))


def test_daily_counts_stream_matches_closed_days(spark, sf, tmp_path, rows):
    land = str(tmp_path / "events")
    events = fx.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(land)
    stream = spark.readStream.schema(events.schema).parquet(land)
    q = (daily_counts(stream, ["event_type"], delay="1 day").writeStream.format("memory").queryName("daily")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = rows(spark.table("daily"))
    twin = daily_counts(events, ["event_type"])
    last = events.agg(F.max("ts")).first()[0]
    closed = twin.filter(F.col("day") + F.expr("interval 1 day") <= F.lit(last - dt.timedelta(days=1)))
    assert got == rows(closed) and len(got) > 100


def _fetches(spark, tmp_path, name, data):
    path = str(tmp_path / name)
    df = spark.createDataFrame(
        [(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for u, s in data], "url string, fetched_at timestamp")
    df.coalesce(1).write.parquet(path)
    return path, spark.readStream.schema(df.schema).parquet(path)


def test_gate_lets_through_after_life_time(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", refetch.ROCKSDB)
    data = [("a", 0), ("a", 3600), ("a", 3601), ("a", 7000), ("a", 7202), ("b", 10), ("b", 20)]
    _, stream = _fetches(spark, tmp_path, "f", data)
    q = (refetch.gate_refetches(stream).writeStream.format("memory").queryName("gate").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    start = dt.datetime(2024, 1, 1)
    got = sorted((r.url, int((r.fetched_at - start).total_seconds())) for r in spark.table("gate").collect())
    # exactly at the life time is still fresh, one second later is not
    assert got == [("a", 0), ("a", 3601), ("a", 7202), ("b", 10)]


def test_gate_orders_a_key_over_small_chunks(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", refetch.ROCKSDB)
    seconds = [9000, 0, 4000, 3601, 7202, 100]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        _, stream = _fetches(spark, tmp_path, "c", [("a", s) for s in seconds])
        q = (refetch.gate_refetches(stream).writeStream.format("memory").queryName("chunks").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    start = dt.datetime(2024, 1, 1)
    got = sorted(int((r.fetched_at - start).total_seconds()) for r in spark.table("chunks").collect())
    assert got == [0, 3601, 7202]


def test_first_within_watermark(spark, tmp_path):
    _, stream = _fetches(spark, tmp_path, "g", [("a", 0), ("a", 10), ("b", 5)])
    q = (refetch.first_within_watermark(stream).writeStream.format("memory").queryName("within").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("within").groupBy("url").count().filter("count > 1").count() == 0
    assert spark.table("within").count() == 2


def test_scored_intake_equals_batch(spark, sf, tmp_path, rows):
    """Three sources in one stream: the same postings as the batch flow, over all phases, and nothing twice."""
    from careerlens.catalog import scoring
    from careerlens.plans import scored_flow

    root, ck = str(tmp_path / "root"), str(tmp_path / "ck")
    pages = scoring.flow_pages(spark, sf)
    details, profile, extract = scoring.flow_details(spark, sf), fx.profile(spark, sf), scoring.flow_records(spark, sf)
    sources = {}
    for kind in ("sites", "generic", "boards"):
        land = str(tmp_path / kind)
        pages.where(F.col("kind") == kind).drop("kind").coalesce(1).write.parquet(land)
        sources[kind] = land
    found = F.to_timestamp(F.lit(AT))

    def run(name):
        streams = {k: spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for k, p in sources.items()}
        intake.start_scored_intake(streams, root, details, profile, name, found, ck, scoring.FLOW_POLICY, extract).awaitTermination()

    run("scored")
    listings = {k: pages.where(F.col("kind") == k).withColumnRenamed("url", "page_url") for k in scoring.FLOW_POLICY.listings}
    matches = scored_flow.scan_matches(extract(pages.where("kind = 'sites'")), listings, details, lambda r: r, profile, scoring.FLOW_POLICY)
    won = scored_flow.first_matches(matches)
    got = store.read_postings(spark, root)
    assert rows(got, "company", "title", "url") == rows(won, "company", "title", "url")
    phases = {r.phase: r.n for r in won.groupBy("phase").agg(F.count("*").alias("n")).collect()}
    assert set(phases) == {"sites", "generic", "boards"} and matches.count() > won.count()
    assert spark.read.parquet(f"{root}/alerts").count() == got.count()
    assert got.where("notes like 'AI-matched. Score: %' and match_score is not null").count() == got.count()
    # the same pages again are all known
    for kind, land in sources.items():
        pages.where(F.col("kind") == kind).drop("kind").coalesce(1).write.mode("append").parquet(land)
    before = got.count()
    run("scored")
    assert store.read_postings(spark, root).count() == before


def test_repeated_scored_batch_replaces_itself(spark, sf, tmp_path, rows):
    from careerlens.catalog import scoring

    root = str(tmp_path / "root")
    args = (root, scoring.flow_details(spark, sf), fx.profile(spark, sf), F.to_timestamp(F.lit(AT)), scoring.FLOW_POLICY,
            scoring.flow_records(spark, sf))
    pages = scoring.flow_pages(spark, sf)
    first = intake.process_scored_batch(pages, "r1", *args)
    before = rows(store.read_postings(spark, root), "url", "run_id")
    assert first == {"matches": len(before), "added": len(before), "duplicates": 0} and before
    assert intake.process_scored_batch(pages, "r1", *args) == first
    assert rows(store.read_postings(spark, root), "url", "run_id") == before
    assert intake.process_scored_batch(pages, "r2", *args)["added"] == 0
