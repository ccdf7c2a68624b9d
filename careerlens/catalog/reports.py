"""Reports, run health and due targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from careerlens.catalog.registry import query
from careerlens.operators import report, rules
from careerlens.catalog.rules import _FAULTY_SQL, _RECORD_REASON, _faulty
from careerlens.sources import standins as fx
from careerlens.streaming.daily import daily_counts


@query("src4_postings_feed", using="fx_postings", sql="""
select id, company, title, date_found, url, applied_status, keywords_matched, resume_generated, notes
from fx_postings order by date_found desc, url""")
def src4(spark, sf):
    return report.feed(fx.postings(spark, sf))


@query("src5_run_log", using="fx_run_log", sql="""
select ts, company, status, postings_found, error_message from fx_run_log""")
def src5(spark, sf):
    return fx.run_log(spark, sf).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "company", "status", "postings_found", "error_message")


@query("ag1_kpis", using="fx_postings", sql="""
select count(*) as total, count(*) filter (applied_status = 'Pending') as pending,
  count(*) filter (applied_status = 'Applied') as applied,
  count(*) filter (applied_status = 'Interview') as interview,
  count(*) filter (resume_generated) as resume_ready from fx_postings""")
def ag1(spark, sf):
    return report.kpis(fx.postings(spark, sf))


@query("ag2_per_company", using="fx_postings", sql="select company, count(*) as n from fx_postings group by 1")
def ag2(spark, sf):
    return report.count_by(fx.postings(spark, sf), "company")


@query("ag3_per_status", using="fx_postings", sql="select applied_status, count(*) as n from fx_postings group by 1")
def ag3(spark, sf):
    return report.count_by(fx.postings(spark, sf), "applied_status")


@query("ag4_per_day", using="fx_postings", sql="select date_found as day, count(*) as n from fx_postings group by 1")
def ag4(spark, sf):
    return report.per_day(fx.postings(spark, sf))


@query("ag5_run_metrics", using="fx_run_log", sql="""
select case when grouping(company) = 1 then 'all' else 'company' end as scope, company, count(*) as runs,
  count(*) filter (status = 'Success') as successes, count(*) filter (status <> 'Success') as failures,
  cast(coalesce(sum(postings_found) filter (status = 'Success'), 0) as bigint) as found,
  count(*) filter (status = 'Success') / count(*)::double as success_rate
from fx_run_log group by rollup (company)""")
def ag5(spark, sf):
    return report.run_metrics(fx.run_log(spark, sf))


@query("ag6_success_rate", using="fx_run_log", sql="""
select count(*) filter (status = 'Success') / count(*)::double as success_rate from fx_run_log""")
def ag6(spark, sf):
    return report.success_rate(fx.run_log(spark, sf))


_HEALTH_SQL = """
  h as (
    select company, case when error_message is not null then 'FAIL' when postings_found > 0 then 'PASS'
      else 'WARN' end as status,
      case when error_message is not null then 0 else postings_found end as found from fx_run_log)
"""


def _health(spark, sf):
    return report.health_rows(fx.run_log(spark, sf).withColumnRenamed("error_message", "error"))


@query("ag7_health_report", using="fx_run_log", sql=f"""
with {_HEALTH_SQL}, t as (select count(*) as total, cast(sum(found) as bigint) as found from h)
select s.status, count(h.status) as n, count(h.status) * 100.0::double / any_value(t.total) as percent,
  any_value(t.total) as total, any_value(t.found) as found
from (values ('PASS'), ('WARN'), ('FAIL')) s(status) left join h on h.status = s.status, t group by s.status""")
def ag7(spark, sf):
    return report.health_report(_health(spark, sf))


@query("ag8_health_verdict", using="fx_run_log", sql=f"""
with {_HEALTH_SQL}, c as (
  select count(*) as total, count(*) filter (status = 'PASS') as passed,
    count(*) filter (status = 'WARN') as warned, count(*) filter (status = 'FAIL') as failed,
    cast(sum(found) as bigint) as found from h)
select *, case when failed > 0 then 'attention' when warned > 0 then 'healthy' else 'operational' end as verdict
from c""")
def ag8(spark, sf):
    return report.health_verdict(_health(spark, sf))


@query("ag10_batch_quality", using="fx_records", sql=f"""
with {_FAULTY_SQL}, r as (select *, {_RECORD_REASON} as reason from checked)
select company, count(*) as scraped, count(distinct case when reason is null then url end) as kept,
  count(*) - count(distinct case when reason is null then url end) as filtered from r group by company""")
def ag10(spark, sf):
    return report.batch_quality(rules.tag_records(_faulty(spark, sf)))


@query("ag11_filter_options", using="fx_postings", sql="select distinct company from fx_postings")
def ag11(spark, sf):
    return report.options(fx.postings(spark, sf), "company")


@query("ag12_row_count", using="fx_postings", sql="select count(*) as total from fx_postings")
def ag12(spark, sf):
    return report.total(fx.postings(spark, sf))


@query("sl1_newest_first", using="fx_postings", sql="""
select id, url, date_found from fx_postings order by date_found desc, url""")
def sl1(spark, sf):
    return report.newest_first(fx.postings(spark, sf).select("id", "url", "date_found"))


@query("sl2_recent", using="fx_postings", sql="""
select id, company, title, url, date_found from fx_postings order by date_found desc, url limit 20""")
def sl2(spark, sf):
    return report.recent(fx.postings(spark, sf).select("id", "company", "title", "url", "date_found"), 20)


@query("sm4_daily_counts", sql="""
select date_trunc('day', ts)::timestamp as day, event_type as status, count(*) as n from events group by 1, 2""")
def sm4(spark, sf):
    events = fx.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    return daily_counts(events, ["status"]).select(
        F.col("day").cast("timestamp_ntz").alias("day"), "status", "n")


@query("sm6_due_targets", using="fx_run_log", sql="""
with t as (
  select distinct 'site' || cast(user_id % 12 as varchar) as company,
    case when user_id % 12 < 4 then 12 when user_id % 12 < 6 then 0 else 24 end as check_interval_hours from events),
last as (select company, max(ts) as last_run from fx_run_log group by company)
select t.company, cast(t.check_interval_hours as int) as check_interval_hours, last_run
from t left join last using (company)
where last_run is null or last_run + to_hours(t.check_interval_hours) <= timestamp '2024-01-31 00:00:00'
""")
def sm6(spark, sf):
    user = F.col("user_id") % 12
    targets = fx.table(spark, sf, "events").select(
        F.concat(F.lit("site"), user.cast("string")).alias("company"),
        F.when(user < 4, 12).when(user < 6, 0).otherwise(24).alias("check_interval_hours")).distinct()
    due = report.due_targets(targets, fx.run_log(spark, sf), F.to_timestamp(F.lit("2024-01-31 00:00:00")))
    return due.select("company", "check_interval_hours", F.col("last_run").cast("timestamp_ntz").alias("last_run"))
