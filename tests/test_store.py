"""Written tables: insert-once, edits, retention, export, metrics."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from careerlens import schemas
from careerlens.operators import report, store
from careerlens.sources import tables as src

def at():
    return F.to_timestamp(F.lit("2025-02-10 12:00:00"))


def _batch(spark, *rows):
    return spark.createDataFrame(
        [(i, c, t, u, [k]) for i, (c, t, u, k) in enumerate(rows)],
        "n int, company string, title string, url string, keywords array<string>")


def _insert(spark, root, batch, run_id, found=None):
    rows = store.as_postings(store.dedup_by_url(batch, ["n"]), at() if found is None else found, matched=F.col("keywords"))
    return store.insert_run(spark, root, rows, run_id)


def test_insert_if_absent_twice_is_once(spark, tmp_path, rows):
    root = str(tmp_path)
    _insert(spark, root, _batch(spark, ("x", "old", "b", "k")), "r0")
    batch = _batch(spark, ("c1", "first", "a", "k1"), ("c1", "known", "b", "k2"), ("c2", "again", "a", "k3"))
    got = _insert(spark, root, batch, "r1")
    assert rows(got, "company", "title", "url", "applied_status") == [("c1", "first", "a", "Pending")]
    assert _insert(spark, root, batch, "r2").count() == 0
    assert rows(store.read_postings(spark, root), "url", "run_id") == [("a", "r1"), ("b", "r0")]
    summary = report.save_summary(store.tag_new(batch, spark.createDataFrame([("b",)], "url string"), ["n"])).first()
    assert tuple(summary) == (3, 1, 2)


def test_counts_of_inserts_without_a_new_row(spark, tmp_path):
    root = str(tmp_path)
    batch = store.as_postings(_batch(spark, ("c", "t", "a", "k"), ("c", "t", "b", "k")), at(), matched=F.col("keywords"))
    assert store.insert_counted(spark, root, batch.limit(0), "r0")[1] == {"matches": 0, "added": 0, "duplicates": 0}
    assert store.insert_counted(spark, root, batch.where("url = 'a'"), "r1")[1] == {"matches": 1, "added": 1, "duplicates": 0}
    for run_id, added in (("r2", 1), ("r2", 1), ("r3", 0), ("r3", 0)):
        rows, counts = store.insert_counted(spark, root, batch, run_id)
        assert counts == {"matches": 2, "added": added, "duplicates": 2 - added} and rows.count() == added


def test_new_rows_keeps_the_first_by_order(spark, rows):
    history = spark.createDataFrame([("b",)], "url string")
    batch = _batch(spark, ("c1", "first", "a", "k"), ("c1", "x", "b", "k"), ("c2", "second", "a", "k"))
    assert rows(store.new_rows(batch, history, ["n"]), "title", "url") == [("first", "a")]


def test_edits_store_nulls_and_ignore_unknown_keys(spark, tmp_path, rows):
    root = str(tmp_path)
    _insert(spark, root, _batch(spark, ("c", "t", "a", "k"), ("c", "t2", "b", "k")), "r1")
    base = store.read_postings(spark, root).withColumn("notes", F.lit("old"))
    key = base.filter("url = 'a'").first().id
    edits = spark.createDataFrame(
        [(key, 1, "Applied", "n", False), (key, 2, "Offer", None, True), ("nope", 1, "Offer", "z", True)],
        "id string, edit_no int, applied_status string, notes string, resume_generated boolean")
    changed = store.apply_edits(base, edits)
    assert store.rewrite(spark, root, changed) == 1
    got = store.read_postings(spark, root)
    assert rows(got, "url", "applied_status", "notes", "resume_generated") == [
        ("a", "Offer", None, True), ("b", "Pending", "old", False)]
    # a later run appends to the new version
    _insert(spark, root, _batch(spark, ("c", "t3", "d", "k")), "r2")
    assert store.read_postings(spark, root).count() == 3


def test_retention_cutoff_is_midnight(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2025, 1, 11)), (2, dt.datetime(2025, 1, 10, 23, 59, 59)), (3, None)],
        "id int, date_found timestamp")
    assert sorted(r.id for r in store.retain(df, at()).collect()) == [1, 3]
    assert [r.id for r in store.expired(df, at()).collect()] == [2]


def test_retention_prunes_day_partitions(spark, tmp_path):
    root = str(tmp_path)
    for day, url in ((1, "a"), (20, "b")):
        _insert(spark, root, _batch(spark, ("c", "t", url, "k")), f"r{day}", F.to_timestamp(F.lit(f"2025-01-{day:02d} 10:00:00")))
    kept = store.retain(store.read_postings(spark, root), F.to_date(F.lit("2025-02-10")), column="found_day")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(found_day" in plan or "found_day" in plan.split("PartitionFilters:")[1][:200]
    assert [r.url for r in kept.collect()] == ["b"]


def test_csv_export_round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(
        [(1, 'say "hi", all', "line 1\nline 2", ["a", "b"], dt.datetime(2025, 1, 2, 3, 4, 5)), (2, None, "", [], None)],
        "id int, title string, notes string, matched array<string>, at timestamp")
    store.export_csv(df, path)
    back = store.read_csv_export(spark, path, "id int, title string, notes string, matched string, at timestamp")
    got = {r.id: r for r in back.collect()}
    assert got[1].title == 'say "hi", all' and got[1].notes == "line 1\nline 2" and got[1].matched == "a, b"
    assert got[1].at == dt.datetime(2025, 1, 2, 3, 4, 5) and got[2].title is None


def _log(spark, *runs):
    return spark.createDataFrame(
        [(dt.datetime(2025, 1, 1, i), c, s, n, None) for i, (c, s, n) in enumerate(runs)], schemas.RUN_LOG)


def test_run_metrics_and_their_file(spark, tmp_path):
    log = _log(spark, ("s1", "Success", 3), ("s1", "Error", 0), ("s2", "Success", 0))
    metrics = report.run_metrics(log)
    got = {r.company: (r.runs, r.successes, r.failures, r.found) for r in metrics.collect()}
    assert got == {"s1": (2, 1, 1, 3), "s2": (1, 1, 0, 0), None: (3, 2, 1, 3)}
    assert report.success_rate(log).first()[0] == pytest.approx(2 / 3)
    assert report.success_rate(log.limit(0)).first()[0] == 0.0
    store.save_metrics(metrics, str(tmp_path / "m"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert len(lines) == 3 and {x["scope"] for x in lines} == {"all", "company"}
    store.log_runs(log, str(tmp_path), "r1")
    store.log_runs(log, str(tmp_path), "r1")
    assert store.read_run_log(spark, str(tmp_path)).count() == 3


def test_health(spark):
    checks = spark.createDataFrame([("a", 3, None), ("b", 0, None), ("c", None, "boom")],
                                   "company string, postings_found int, error string")
    rows = report.health_rows(checks)
    report_rows = {r.status: (r.n, round(r.percent, 1), r.found) for r in report.health_report(rows).collect()}
    assert report_rows == {"PASS": (1, 33.3, 3), "WARN": (1, 33.3, 3), "FAIL": (1, 33.3, 3)}
    assert report.health_verdict(rows).first().verdict == "attention"
    assert report.health_verdict(rows.filter("status <> 'FAIL'")).first().verdict == "healthy"
    assert report.health_verdict(rows.filter("status = 'PASS'")).first().verdict == "operational"


def test_rendered_keywords_and_notes(spark):
    df = spark.createDataFrame([(["a", "b"], 0.7312, "x"), ([], 0.7312, "x")], "k array<string>, s double, t string")
    out = df.select(store.rendered_keywords(F.col("k"), F.col("s")).alias("r"),
                    store.score_notes(F.col("s"), F.col("t")).alias("n")).collect()
    assert [r.r for r in out] == ["a, b", "Semantic Match: 0.73"]
    assert out[0].n == "AI-matched. Score: 0.73\nx"


def test_point_lookup_and_description_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, title string")
    assert report.require_posting(df, 2).first().title == "b"
    with pytest.raises(ValueError):
        report.require_posting(df, 9)
    (tmp_path / "d.txt").write_text("line 1\nline 2 é", encoding="utf-8")
    rows = src.read_description(spark, str(tmp_path / "d.txt")).collect()
    assert [r.description for r in rows] == ["line 1\nline 2 é"] and rows[0].file.endswith("d.txt")


def test_freshness_boundary(spark):
    from careerlens.operators import rules

    as_of = dt.datetime(2025, 1, 1, 1)
    df = spark.createDataFrame(
        [("a", dt.datetime(2025, 1, 1)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 12, 31, 23, 59, 59, 999999))],
        "url string, fetched_at timestamp")
    assert [r.url for r in rules.fresh_snapshots(df, F.lit(as_of)).collect()] == ["a"]
    assert [r.url for r in rules.expired_snapshots(df, F.lit(as_of)).collect()] == ["b"]


def test_csv_keeps_blanks_empty_texts_and_nulls(spark, tmp_path, rows):
    data = [(1, "  padded  "), (2, ""), (3, None), (4, "a,\"b\"")]
    store.export_csv(spark.createDataFrame(data, "id int, title string"), str(tmp_path / "csv"))
    assert rows(store.read_csv_export(spark, str(tmp_path / "csv"), "id int, title string")) == data


def test_sketches_of_days_merge_to_the_whole(spark):
    """A preview from daily sketches is within the error of one sketch over everything, however the days are merged."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("u"), F.col("id") % 70_000).alias("url"),
        F.expr("timestamp '2025-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 90 as int))").alias("date_found"))
    days = report.daily_sketches(rows, "url")
    assert days.count() == 90
    whole = report.distinct_preview(days, "url").first()
    assert whole.n == 200_000 and abs(whole.url - 70_000) < 0.03 * 70_000
    months = report.merged_sketches(days.withColumn("month", F.trunc("day", "month")), "url", keys=("month",))
    assert report.distinct_preview(months, "url").first() == whole
    direct = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg("url", report.SKETCH_BITS))).first()[0]
    assert abs(direct - whole.url) < 0.02 * 70_000
