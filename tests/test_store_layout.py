"""The written store: what moves, what is written, what is read."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from careerlens import schemas
from careerlens.operators import store

AT = F.to_timestamp


def postings(spark, urls, found="2025-02-10 12:00:00", company="c"):
    rows = spark.createDataFrame([(company, f"title {u}", u) for u in urls], "company string, title string, url string")
    return store.as_postings(rows, F.to_timestamp(F.lit(found)), matched=F.array(F.lit("k")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(root):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names}


def side_of(text, marker):
    """The lines above the scan that holds ``marker``, up to the join that it feeds."""
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if "Scan" in line and marker in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for line in reversed(lines[:at]):
        if "Join" in line and depth(line) < depth(lines[at]):
            break
        out.append(line)
    return out


@pytest.fixture
def filled(spark, tmp_path):
    root = str(tmp_path / "store")
    for run in range(3):
        store.insert_run(spark, root, postings(spark, [f"https://x/{i}" for i in range(run * 1000, run * 1000 + 1500)]), f"r{run}")
    return root


def test_runs_equal_the_anti_join(spark, filled):
    got = store.read_postings(spark, filled)
    assert got.count() == got.select("url").distinct().count() == 3500
    assert {r.run_id: r.n for r in got.groupBy("run_id").agg(F.count("*").alias("n")).collect()} == {"r0": 1500, "r1": 1000, "r2": 1000}
    batch = postings(spark, [f"https://x/{i}" for i in range(3000, 4200)] + ["https://x/-1"])
    want = batch.join(got.select("url"), "url", "left_anti").select("url")
    new = store.insert_run(spark, filled, batch, "r3").select("url")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, want.collect())) and new.count() == 701


def test_history_is_not_shuffled(spark, filled):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = postings(spark, [f"https://x/{i}" for i in range(900, 1200)]).select("url")
        known = store.known_urls(spark, filled, batch, "r9")
        text = plan(known)
        above = side_of(text, "Bucketed: true")
        assert "SelectedBucketsCount" in text and not any("Exchange" in line for line in above), text
        assert known.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_keeps_all_stored_urls_and_few_others(spark):
    urls = spark.range(60_000).select(F.concat(F.lit("https://x/"), "id").alias("url"))
    filters = store.filter_rows(urls.where("url < 'https://x/5'"), words=8192).repartition(3)
    stored = urls.where("url < 'https://x/5'")
    assert store.possible_hits(stored, filters, words=8192).count() == stored.count()
    others = urls.where("url >= 'https://x/5'")
    assert store.possible_hits(others, filters, words=8192).count() < 0.05 * others.count()
    assert filters.count() <= 8192


def test_history_is_not_read_without_possible_hits(spark, filled):
    batch = spark.createDataFrame([("https://y/1",)], "url string")
    assert store.known_urls(spark, filled, batch, "r9") is None


def test_edits_write_only_the_log_and_outlive_a_replay(spark, filled):
    before = files(f"{filled}/postings")
    keys = {r.url: r.id for r in store.read_postings(spark, filled).where("url in ('https://x/1', 'https://x/2')").collect()}
    kind = "id string, edit_no long, applied_status string, notes string, resume_generated boolean"
    edits = [(keys["https://x/1"], 1, "Applied", "a", False), (keys["https://x/1"], 5, "Offer", None, True),
             (keys["https://x/2"], 2, "Applied", "b", None), ("unknown", 9, "Offer", "x", True)]
    store.record_edits(spark, filled, spark.createDataFrame(edits, kind), "e1")
    store.record_edits(spark, filled, spark.createDataFrame([(keys["https://x/1"], 3, "Late", "z", False)], kind), "e2")
    assert files(f"{filled}/postings") == before

    def state():
        rows = store.read_postings(spark, filled).where("applied_status <> 'Pending'").collect()
        return sorted((r.url, r.applied_status, r.notes, r.resume_generated) for r in rows)

    want = [("https://x/1", "Offer", None, True), ("https://x/2", "Applied", "b", None)]
    assert state() == want
    store.insert_run(spark, filled, postings(spark, [f"https://x/{i}" for i in range(1500)]), "r0")
    assert state() == want and store.read_postings(spark, filled).count() == 3500
    store.record_edits(spark, filled, spark.createDataFrame(edits, kind), "e1")  # a repeated call
    store.compact_edits(spark, filled, "folded")
    assert state() == want and os.listdir(f"{filled}/edits") != [] and not os.path.exists(f"{filled}/edits/edit_run=e1")
    assert spark.read.parquet(f"{filled}/edits").count() == 2
    store.record_edits(spark, filled, spark.createDataFrame([(keys["https://x/2"], 7, "Offer", None, True)], kind), "e3")
    assert state() == [want[0], ("https://x/2", "Offer", None, True)]


def test_reading_edits_moves_no_posting(spark, filled):
    one = store.read_postings(spark, filled).limit(1).select("id", *store.EDITED).withColumn("edit_no", F.lit(1))
    store.record_edits(spark, filled, one, "e1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(store.read_postings(spark, filled))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_retention_deletes_days_by_name(spark, tmp_path):
    root = str(tmp_path / "store")
    store.insert_run(spark, root, postings(spark, ["a", "b"], "2025-01-01 10:00:00"), "r1")
    store.insert_run(spark, root, postings(spark, ["c"], "2025-01-11 00:00:00"), "r2")
    undated = postings(spark, ["d"]).withColumn("date_found", F.lit(None).cast("timestamp"))
    store.insert_run(spark, root, undated, "r3")
    before = files(f"{root}/postings")
    as_of = F.to_timestamp(F.lit("2025-02-10 12:00:00"))
    assert store.drop_expired(spark, root, as_of) == 2 and store.drop_expired(spark, root, as_of) == 0
    after = files(f"{root}/postings")
    assert after == {f: t for f, t in before.items() if "2025-01-01" not in f}
    assert sorted(r.url for r in store.read_postings(spark, root).collect()) == ["c", "d"]
    # an address whose posting is gone may come back
    new = store.insert_run(spark, root, postings(spark, ["a", "c"]), "r4")
    assert [r.url for r in new.collect()] == ["a"]


def test_rewritten_version_keeps_the_history(spark, filled):
    assert store.rewrite(spark, filled, store.read_postings(spark, filled)) == 1
    assert store.read_postings(spark, filled).count() == 3500
    assert store.insert_run(spark, filled, postings(spark, ["https://x/7", "new"]), "r8").count() == 1


def test_a_day_of_its_own_for_every_row(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("c", "t", f"u{i}", dt.datetime(2025, 1, 1 + i)) for i in range(5)],
                                 "company string, title string, url string, at timestamp")
    store.insert_run(spark, root, store.as_postings(rows, F.col("at")), "r1")
    got = store.read_postings(spark, root)
    assert got.select("found_day").distinct().count() == 5 and set(schemas.POSTINGS.names) <= set(got.columns)
