"""Predicates, lookups, joins and deduplication."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from careerlens.catalog.extraction import ANCHORS, ORIGIN
from careerlens.catalog.registry import query, sql_any, sql_hits, sql_list, sql_text
from careerlens.functions import urls
from careerlens.functions.text import matches_keywords
from careerlens.lexicon import CandidatePolicy, LinkPolicy, SiteRule
from careerlens.operators import dedup, report, rules, store
from careerlens.operators.anchors import text_anchors, titled_anchors
from careerlens.operators.keywords import keyword_hits, matched_keywords
from careerlens.operators.score import with_similarity
from careerlens.session import scratch_folder
from careerlens.sources import standins as fx
from careerlens.sources import tables as src

KEYWORDS = ("License", "Apache", "That", "Zuk", "Éau", "the of")
LINKS = LinkPolicy(min_text=3)
CORPUS = replace(
    CandidatePolicy(), min_title=3, skip_title_terms=("the", "eau"), text_exclusions=("ont", "ing"),
    url_exclusions=("spam", "#"), button_labels=("and", "que"), category_labels=("for", "des"),
    posting_url_terms=(".com/", ".org/"), role_terms=("E", "ich"))
RULES = (
    SiteRule("blog.tionsh.example.net", ("a",), (".net/",), False, 3),
    SiteRule("thther.example.org", (), (), True, 5),
    SiteRule("m.ththth.example.net", ("i", "o"), (), False, None),
)


def _anchors(spark, sf):
    return text_anchors(fx.pages(spark, sf).withColumnRenamed("url", "page_url"))


def _clean(spark, sf):
    return urls.with_clean_url(_anchors(spark, sf), "href", "page_url", "url")


def _titled(spark, sf):
    links = titled_anchors(fx.pages(spark, sf).withColumnRenamed("url", "page_url"))
    return urls.with_joined_url(links, "href", "page_url", "url").withColumnRenamed("site", "company")


_LINKS_SQL = f"{ANCHORS}, links as (select *, {ORIGIN} || href as url from anchors)"


@query("pr1_contains_any", using="fx_records", sql=f"""
select doc_id, {sql_any('lower(text)', KEYWORDS, lower=True)} as hit, true as hit_empty from fx_records""")
def pr1(spark, sf):
    return fx.records(spark, sf).select(
        "doc_id", matches_keywords(F.col("text"), KEYWORDS).alias("hit"),
        matches_keywords(F.col("text"), ()).alias("hit_empty"))


@query("pr2_matched_keywords", using="fx_records", sql=f"""
select * from (select doc_id, array_to_string({sql_hits('lower(text)', KEYWORDS)}, '|') as matched_keywords
  from fx_records) where matched_keywords <> ''""")
def pr2(spark, sf):
    docs = fx.records(spark, sf).withColumn("keywords", F.array(*[F.lit(k) for k in KEYWORDS]))
    out = rules.with_matched_keywords(docs, F.col("text"))
    return out.select("doc_id", F.array_join("matched_keywords", "|").alias("matched_keywords"))


@query("pr3_link_validity", using="fx_pages", sql=f"""
with {_LINKS_SQL}
select page_id, pos, not {sql_any('lower(url)', LINKS.url_exclusions)} and length(anchor_text) >= 3 as is_valid
from links""")
def pr3(spark, sf):
    return rules.with_link_check(_clean(spark, sf), LINKS).select("page_id", "pos", "is_valid")


_RULE_ROWS = ", ".join(
    f"({sql_text(r.company)}, {sql_list(r.allow_text_contains)}, {sql_list(r.extra_url_patterns)}, "
    f"{str(r.bypass_title_skip).lower()}, {'null' if r.max_links is None else r.max_links})" for r in RULES)
_RULED_SQL = f"""{_LINKS_SQL},
  rules as (select * from (values {_RULE_ROWS}) t(company, allow, extra, bypass, cap)),
  ruled as (
    select l.*, l.site as company, coalesce(allow, []::varchar[]) as allow,
      coalesce(extra, []::varchar[]) as extra, coalesce(bypass, false) as bypass, cap
    from links l left join rules r on l.site = r.company),
  skipped as (
    select *, lower(anchor_text) as t, lower(url) as u,
      len(list_filter(allow, lambda k: contains(lower(anchor_text), k))) > 0 as allowed from ruled),
  judged as (
    select *, case when bypass or allowed then false when length(t) < 3 then true
      else {sql_any('t', CORPUS.skip_title_terms)} end as skip from skipped)
"""


@query("pr4_title_skip", using="fx_pages", sql=f"with {_RULED_SQL} select page_id, pos, skip from judged")
def pr4(spark, sf):
    links = rules.with_site_rules(_titled(spark, sf), RULES)
    return rules.with_title_skip(links, CORPUS, "anchor_title").select("page_id", "pos", "skip")


_REASON_SQL = f"""
  case when skip then 'title'
    when {sql_any('u', CORPUS.url_exclusions)} then 'url_excluded'
    when {sql_any('t', CORPUS.text_exclusions)} then 'text_excluded'
    when list_contains({sql_list(CORPUS.button_labels)}, t) then 'button'
    when list_contains({sql_list(CORPUS.category_labels)}, t) then 'category'
    when not ({sql_any('u', CORPUS.posting_url_terms)}
      or len(list_filter(extra, lambda k: contains(u, k))) > 0) then 'no_posting_path'
    when not ({sql_any('t', CORPUS.role_terms, lower=True)} or allowed) then 'no_role_word' end"""


@query("pr5_candidate_reasons", using="fx_pages", sql=f"""
with {_RULED_SQL} select page_id, pos, url, {_REASON_SQL} as reject_reason from judged""")
def pr5(spark, sf):
    links = rules.with_site_rules(_titled(spark, sf), RULES)
    links = rules.with_candidate_reason(links, CORPUS, text="anchor_title")
    return links.select("page_id", "pos", "url", "reject_reason")


_DEFAULT = CandidatePolicy()


@query("pr5_default_policy", using="fx_records", sql=f"""
with c as (select doc_id, lower(title) as t, lower(url) as u from fx_records)
select doc_id, case when length(trim(t)) < 15 or {sql_any('t', _DEFAULT.skip_title_terms)} then 'title'
  when {sql_any('u', _DEFAULT.url_exclusions)} then 'url_excluded'
  when {sql_any('t', _DEFAULT.text_exclusions)} then 'text_excluded'
  when list_contains({sql_list(_DEFAULT.button_labels + _DEFAULT.category_labels)}, trim(t)) then 'label'
  when not {sql_any('u', _DEFAULT.posting_url_terms)} then 'no_posting_path'
  when not {sql_any('t', _DEFAULT.role_terms, lower=True)} then 'no_role_word' end as reject_reason
from c""")
def pr5_default(spark, sf):
    rows = rules.with_candidate_reason(rules.with_site_rules(fx.records(spark, sf), ()))
    reason = F.col("reject_reason")
    return rows.select("doc_id", F.when(reason.isin("button", "category"), "label").otherwise(reason)
                       .alias("reject_reason"))


# Every outcome of the default lists that a title of 15 characters can have, for every record: form, title, path, reason.
_OUTCOMES = (
    ("candidate", "Software Engineer ", "jobs/", None), ("short", "Engineer", "jobs/", "title"),
    ("skipped", "Learn more, engineer ", "jobs/", "title"), ("blog", "Software Engineer ", "blog/jobs/", "url_excluded"),
    ("subscribe", "Subscribe, engineer ", "jobs/", "text_excluded"), ("category", " Career Opportunities ", "jobs/", "category"),
    ("elsewhere", "Software Engineer ", "", "no_posting_path"), ("no role", "Zuk zuk zuk zuk ", "jobs/", "no_role_word"),
    ("both", "Subscribe, engineer ", "blog/", "url_excluded"))
_BARE = ("short", "category")


@query("pr5_default_outcomes", using="fx_records", sql=" union all ".join(
    f"select doc_id, {sql_text(form)} as form, {sql_text(reason) if reason else 'null'} as reject_reason from fx_records"
    for form, _, _, reason in _OUTCOMES))
def pr5_outcomes(spark, sf):
    forms = F.array(*[F.struct(
        F.lit(form).alias("form"),
        (F.lit(title) if form in _BARE else F.concat(F.lit(title), "company")).alias("title"),
        F.concat(F.lit(fx.URL_ROOT + path), F.md5("text")).alias("url")) for form, title, path, _ in _OUTCOMES])
    rows = fx.records(spark, sf).select("doc_id", "company", F.inline(forms))
    return rules.with_candidate_reason(rules.with_site_rules(rows, ())).select("doc_id", "form", "reject_reason")


# Records with every kind of fault, by language of the text.
_FAULTY_SQL = """
  faulty as (
    select doc_id, nullif(company, 'src3') as company,
      case lang when 'es' then case doc_id % 3 when 0 then '' when 1 then lang else nullif(company, 'src3') end
        when 'de' then title || ' ' || text else '  ' || nullif(company, 'src3') || ' ' || doc_id || ' ' end as title,
      case lang when 'fr' then 'mailto:' || company else ' ' || url end as bad_url, url, lang from fx_records),
  checked as (
    select doc_id, company, title, case when lang = 'fr' then bad_url else url end as url from faulty)
"""


def _faulty(spark, sf):
    lang = F.col("lang")
    kind = F.col("doc_id") % 3
    title = (F.when((lang == "es") & (kind == 0), "").when((lang == "es") & (kind == 1), lang)
             .when(lang == "es", F.nullif(F.col("company"), F.lit("src3")))
             .when(lang == "de", F.concat("title", F.lit(" "), "text"))
             .otherwise(F.concat(F.lit("  "), F.nullif(F.col("company"), F.lit("src3")), F.lit(" "), "doc_id",
                                 F.lit(" "))))
    return fx.records(spark, sf).select(
        "doc_id", F.nullif(F.col("company"), F.lit("src3")).alias("company"), title.alias("title"),
        F.when(lang == "fr", F.concat(F.lit("mailto:"), "company")).otherwise(F.col("url")).alias("url"))


_RECORD_REASON = """
  case when coalesce(company, '') = '' then 'no_company' when coalesce(title, '') = '' then 'no_title'
    when coalesce(url, '') = '' then 'no_url'
    when not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') then 'bad_url'
    when length(title) < 3 then 'short_title' when length(title) > 300 then 'long_title' end"""


@query("pr6_record_validation", using="fx_records", sql=f"""
with {_FAULTY_SQL} select doc_id, {_RECORD_REASON} as reject_reason from checked""")
def pr6(spark, sf):
    return rules.tag_records(_faulty(spark, sf)).select("doc_id", "reject_reason")


@query("pr7_normalize_records", using="fx_records", sql=f"""
with {_FAULTY_SQL}
select doc_id, trim(title, ' ' || chr(10)) as title, md5(company || '|' || url) as id
from checked where {_RECORD_REASON} is null""")
def pr7(spark, sf):
    valid = rules.tag_records(_faulty(spark, sf)).filter("reject_reason is null")
    return rules.normalize_records(valid).select("doc_id", "title", "id")


@query("pr8_min_content", sql="select doc_id from documents where length(text) >= 200")
def pr8(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.filter(rules.has_enough_text(F.col("text"))).select("doc_id")


@query("pr9_payload_fields", using="fx_records", sql="""
with p as (
  select doc_id, case when lang = 'es' then '  ' else ' ' || title end as title,
    case lang when 'fr' then '' when 'de' then null else text end as text, nullif(url, '') as url from fx_records),
t as (select doc_id, trim(title, ' ' || chr(10)) as title, text from p)
select doc_id, title, coalesce(nullif(text, ''), title) as text from t where title <> ''""")
def pr9(spark, sf):
    lang = F.col("lang")
    rows = fx.records(spark, sf).select(
        "doc_id", "url",
        F.when(lang == "es", "  ").otherwise(F.concat(F.lit(" "), "title")).alias("title"),
        F.when(lang == "fr", "").when(lang == "de", None).otherwise(F.col("text")).alias("text"))
    return rules.with_payload_text(rows).select("doc_id", "title", "text")


@query("pr10_site_terms", using="fx_records", sql=f"""
select doc_id,
  not {sql_any('lower(title)', ('the', 'ß'))} and {sql_any('lower(title)', ('an', 'eau'))}
    and length(title) > 10 as by_lower,
  not {sql_any('upper(title)', ('THE', 'EN'))} as by_upper,
  {sql_any('title', ('The', 'Er'))} as by_exact
from fx_records""")
def pr10(spark, sf):
    t = F.col("title")
    return fx.records(spark, sf).select(
        "doc_id",
        rules.site_terms(t, ("the", "ß"), ("an", "eau"), longer_than=10).alias("by_lower"),
        rules.site_terms(t, ("THE", "EN"), fold="upper").alias("by_upper"),
        rules.site_terms(t, keep_terms=("The", "Er"), fold="exact").alias("by_exact"))


@query("pr12_multi_select", using="fx_postings", sql="""
select id, company, applied_status from fx_postings
where company in ('BUILDING', 'MACHINERY') and applied_status in ('Pending', 'Interview')""")
def pr12(spark, sf):
    chosen = rules.select_in(
        fx.postings(spark, sf), company=["BUILDING", "MACHINERY"], title=[],
        applied_status=["Pending", "Interview"])
    return chosen.select("id", "company", "applied_status")


@query("pr13_snapshot_freshness", sql="""
select 'https://jobs.example.com/u' || user_id as url, max(ts) as fetched_at,
  epoch_us(timestamp '2024-01-30 23:59:00') - epoch_us(max(ts)) <= 36000000000 as is_fresh
from events group by user_id""")
def pr13(spark, sf):
    snaps = fx.table(spark, sf, "events").select(
        F.concat(F.lit("https://jobs.example.com/u"), F.col("user_id").cast("string")).alias("url"),
        F.col("ts").alias("fetched_at"))
    as_of = F.to_timestamp(F.lit("2024-01-30 23:59:00"))
    return rules.with_freshness(snaps, as_of, ttl=36_000).withColumn(
        "fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


# ------------------------------------------------------------------- joins

_SITE_TARGETS = """
  targets as (
    select site as company, case when starts_with(site, 'www.') then ['The', 'une'] else ['ich', 'que', 'and'] end
      as keywords from (select distinct site from fx_pages where not starts_with(site, 'm.')))
"""


def _site_targets(spark, sf):
    sites = fx.pages(spark, sf).select("site").distinct().filter(~F.col("site").startswith("m."))
    words = F.when(F.col("site").startswith("www."), F.array(F.lit("The"), F.lit("une"))).otherwise(
        F.array(F.lit("ich"), F.lit("que"), F.lit("and")))
    return sites.select("site", words.alias("keywords"))


@query("jn1_pages_of_targets", using="fx_pages", sql=f"""
with {_SITE_TARGETS}
select p.page_id, p.site, array_to_string(t.keywords, '|') as keywords
from fx_pages p join targets t on p.site = t.company""")
def jn1(spark, sf):
    from careerlens.plans.keyword_scan import pages_of_targets

    joined = pages_of_targets(fx.pages(spark, sf).drop("html"), _site_targets(spark, sf))
    return joined.select("page_id", "site", F.array_join("keywords", "|").alias("keywords"))


@query("jn2_rule_lookup", using="fx_pages", sql=f"""
with r as (select * from (values {_RULE_ROWS}) t(company, allow, extra, bypass, cap))
select page_id, site as company, array_to_string(coalesce(allow, []::varchar[]), '|') as allow,
  coalesce(bypass, false) as bypass, cast(cap as int) as max_links
from fx_pages p left join r on p.site = r.company""")
def jn2(spark, sf):
    pages = fx.pages(spark, sf).select("page_id", F.col("site").alias("company"))
    return rules.with_site_rules(pages, RULES).select(
        "page_id", "company", F.array_join("allow_text_contains", "|").alias("allow"),
        F.col("bypass_title_skip").alias("bypass"), "max_links")


@query("jn3_link_caps", using="fx_pages", sql="""
select page_id, case site when 'blog.tionsh.example.net' then 3 when 'thther.example.org' then 5 else 30 end
  as default_cap, case site when 'blog.tionsh.example.net' then 3 when 'thther.example.org' then 5 else 12 end
  as board_cap from fx_pages""")
def jn3(spark, sf):
    caps = {r.company: r.max_links for r in RULES if r.max_links}
    pages = fx.pages(spark, sf).select("page_id", F.col("site").alias("company"))
    both = rules.with_link_cap(pages, caps, out="default_cap")
    return rules.with_link_cap(both, caps, 12, out="board_cap").drop("company")


@query("jn4_keyword_pairs", using="fx_records", sql=f"""
select d.doc_id, k.keyword from fx_records d, (select unnest({sql_list(KEYWORDS)}) as keyword) k
where contains(lower(d.text), lower(k.keyword))""")
def jn4(spark, sf):
    return rules.keyword_pairs(fx.records(spark, sf), F.col("text"), KEYWORDS).select("doc_id", "keyword")


# Keywords from a table: the texts of all links of all pages, searched in all documents.
_LINK_TEXTS = """
  words as (select distinct anchor_text as keyword from anchors where anchor_text <> '')
"""


def _link_texts(spark, sf):
    return text_anchors(fx.pages(spark, sf)).select(F.col("anchor_text").alias("keyword")).where("keyword <> ''").distinct()


@query("jn4_keyword_table", using="fx_pages fx_records", sql=f"""
with {ANCHORS}, {_LINK_TEXTS}, low as (select distinct lower(keyword) as word from words)
select doc_id, word from fx_records join low on contains(lower(text), word)""")
def jn4_table(spark, sf):
    return keyword_hits(fx.records(spark, sf), _link_texts(spark, sf), "doc_id")


@query("pr2_keyword_table", using="fx_pages fx_records", sql=f"""
with {ANCHORS}, {_LINK_TEXTS}
select doc_id, string_agg(keyword, '|' order by length(keyword) desc, keyword) as matched
from fx_records join words on contains(lower(text), lower(keyword)) group by doc_id""")
def pr2_table(spark, sf):
    words = _link_texts(spark, sf).withColumn("ord", -F.length("keyword"))
    found = matched_keywords(fx.records(spark, sf), words, "doc_id")
    return found.select("doc_id", F.array_join("matched_keywords", "|").alias("matched"))


@query("jn5_drop_seen", using="fx_records fx_history", sql="""
select min(doc_id) as doc_id, url from fx_records where url not in (select url from fx_history) group by url""")
def jn5(spark, sf):
    unique = dedup.dedup_by_url(fx.records(spark, sf).select("doc_id", "url"), ["doc_id"])
    return dedup.drop_seen(unique, src.seen_keys(fx.history(spark, sf)))


@query("jn6_by_ids", using="fx_postings", sql="""
select id, company, title, url from fx_postings
where id in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def jn6(spark, sf):
    ids = fx.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return report.by_ids(fx.postings(spark, sf), ids).select("id", "company", "title", "url")


@query("jn6_missing_ids", using="fx_postings", sql="""
select distinct l_orderkey + l_quantity::bigint as id from lineitem
where l_orderkey + l_quantity::bigint not in (select id from fx_postings)""")
def jn6b(spark, sf):
    ids = fx.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") + F.col("l_quantity").cast("bigint")).alias("id"))
    return report.missing_ids(fx.postings(spark, sf), ids)


_COSINE = """
  p as (select embedding::double[] as pv from embeddings where vec_id = 0)
"""


@query("jn8_profile_similarity", sql=f"""
with {_COSINE}
select vec_id, round(list_inner_product(embedding::double[], pv)
  / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(pv, pv))), 6)
  as similarity from embeddings, p""")
def jn8(spark, sf):
    rows = with_similarity(fx.table(spark, sf, "embeddings"), fx.profile(spark, sf))
    return rows.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("jn9_pair_with_counts", using="fx_records", sql="""
select s.company, count(r.doc_id) as n from (
  select distinct source as company from documents union all select distinct 'none-' || source from documents) s
left join fx_records r on r.company = s.company and r.lang <> 'en' group by s.company""")
def jn9(spark, sf):
    sources = fx.table(spark, sf, "documents").select("source").distinct()
    sites = sources.select(F.col("source").alias("company")).unionByName(
        sources.select(F.concat(F.lit("none-"), "source").alias("company")))
    return report.pair_with_counts(sites, fx.records(spark, sf).filter("lang <> 'en'"))


# ----------------------------------------------------------- dedup, top-N

@query("wn1_first_per_url", using="fx_records", sql="""
select url, min(doc_id) as doc_id, arg_min(company, doc_id) as company, count(*) > 0 as kept
from fx_records group by url""")
def wn1(spark, sf):
    rows = dedup.dedup_by_url(fx.records(spark, sf).select("doc_id", "url", "company"), ["doc_id"])
    return rows.withColumn("kept", F.lit(True))


@query("wn2_first_title_in_page", using="fx_records", sql="""
select company, title, min(doc_id) as doc_id from fx_records group by company, title""")
def wn2(spark, sf):
    rows = fx.records(spark, sf).select("company", "title", "doc_id")
    return dedup.first_per_key(rows, ["company", "title"], ["doc_id"])


@query("wn3_first_qualifying", using="fx_pages", sql=f"""
with {_LINKS_SQL}, hits as (
  select *, {sql_hits('lower(anchor_text)', ('The', 'ich', 'eau'))} as hit from links
  where not {sql_any('lower(url)', LINKS.url_exclusions)} and length(anchor_text) >= 3),
kept as (
  select *, row_number() over (partition by site, url order by page_id, pos) as rn from hits where len(hit) > 0)
select site, url, page_id, pos, array_to_string(hit, '|') as matched from kept where rn = 1""")
def wn3(spark, sf):
    links = rules.posting_links(_clean(spark, sf), LINKS)
    links = links.withColumn("keywords", F.array(F.lit("The"), F.lit("ich"), F.lit("eau")))
    hits = rules.with_matched_keywords(links, F.col("anchor_text"))
    first = dedup.first_per_key(hits, ["site", "url"], ["page_id", "pos"])
    return first.select("site", "url", "page_id", "pos", F.array_join("matched_keywords", "|").alias("matched"))


@query("wn4_top_n_per_site", using="fx_pages", sql=f"""
with {_LINKS_SQL}, firsts as (
  select site, url, min(page_id * 100000 + pos) as place from links group by site, url),
ranked as (select *, row_number() over (partition by site order by place) as rn from firsts),
capped as (
  select * from ranked where rn <= case site when 'blog.tionsh.example.net' then 3
    when 'thther.example.org' then 5 else 12 end)
select site, url from capped where url not in (
  select {ORIGIN} || href from anchors where anchor_text = 'que' or anchor_text = 'the')""")
def wn4(spark, sf):
    links = _clean(spark, sf).withColumnRenamed("site", "company")
    first = dedup.first_per_key(
        links.select("company", "url", "page_id", "pos"), ["company", "url"], ["page_id", "pos"])
    from careerlens.plans.scored_scan import capped_candidates

    caps = {r.company: r.max_links for r in RULES if r.max_links}
    capped = capped_candidates(first, caps, 12)
    seen = src.seen_keys(links.filter(F.col("anchor_text").isin("que", "the")))
    return dedup.drop_seen(capped, seen).select(F.col("company").alias("site"), "url")


@query("wn5_last_run", using="fx_run_log", sql="""
select ts, company, status, postings_found from fx_run_log order by ts desc, company limit 1""")
def wn5(spark, sf):
    return report.last_run(fx.run_log(spark, sf)).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "company", "status", "postings_found")


@query("wn5_last_run_per_site", using="fx_run_log", sql="""
select company, max(ts) as ts, arg_max(status, ts) as status, arg_max(postings_found, ts) as postings_found
from fx_run_log group by company""")
def wn5b(spark, sf):
    return report.last_run_per_site(fx.run_log(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ------------------------------------------------------------------- store

@query("snk1_insert_if_absent", using="fx_records fx_history", sql="""
with firsts as (
  select url, min(doc_id) as doc_id from fx_records group by url)
select r.doc_id, r.company, r.title, r.url, md5(r.company || '|' || r.url) as id, 'Pending' as applied_status
from firsts f join fx_records r on r.doc_id = f.doc_id where f.url not in (select url from fx_history)""")
def snk1(spark, sf):
    rows = store.new_rows(fx.records(spark, sf), fx.history(spark, sf), ["doc_id"])
    shaped = store.as_postings(rows, F.to_timestamp(F.lit("2024-01-31 00:00:00")), carry=["doc_id"])
    return shaped.select(
        "doc_id", "company", "title", "url", "id", "applied_status")


@query("store_runs_and_edits", using="fx_records fx_history", sql="""
with firsts as (select url, min(doc_id) as doc_id from fx_records group by url),
p as (
  select r.url, r.doc_id, case when h.url is null then 'second' else 'first' end as run_id, l.quality
  from firsts f join fx_records r on r.doc_id = f.doc_id left join fx_history h on h.url = f.url
  left join labels l on l.doc_id = r.doc_id)
select url, run_id, case when quality = 0 then 'Rejected' when quality = 1 then 'Applied' else 'Pending' end as applied_status,
  case when quality = 1 then 'good' end as notes from p""")
def store_runs(spark, sf):
    # the written table: a run of the known addresses, a run of everything twice over, edits, and the second run again
    at = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    root = scratch_folder(spark, "store")
    every = dedup.dedup_by_url(fx.records(spark, sf), ["doc_id"])
    old = every.join(fx.history(spark, sf), "url", "left_semi")
    store.insert_run(spark, root, store.as_postings(old, at), "first")
    store.insert_run(spark, root, store.as_postings(every, at), "second")
    known = fx.table(spark, sf, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    edits = every.join(known, "doc_id").select(
        urls.posting_id(F.col("company"), F.col("url")).alias("id"), F.lit(1).alias("edit_no"),
        F.when(F.col("quality") == 0, "Rejected").otherwise("Applied").alias("applied_status"),
        F.when(F.col("quality") == 1, "good").alias("notes"), F.lit(False).alias("resume_generated"))
    store.record_edits(spark, root, edits.withColumn("edit_no", F.lit(0)).withColumn("notes", F.lit("older")), "e1")
    store.record_edits(spark, root, edits, "e2")
    store.insert_run(spark, root, store.as_postings(every, at), "second")
    return store.read_postings(spark, root).select("url", "run_id", "applied_status", "notes")


_EDITS_SQL = """
  edits as (
    select l_orderkey as id, l_returnflag as flag, l_linestatus as st, l_discount as disc
    from (select *, row_number() over (partition by l_orderkey
        order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as rn
      from lineitem where l_returnflag <> 'N') where rn = 1
    union all select distinct -1 - l_orderkey, 'R', 'F', 0.0 from lineitem)
"""


@query("snk3_keyed_update", using="fx_postings", sql=f"""
with {_EDITS_SQL}
select p.id, case when e.id is null then p.applied_status when e.flag = 'R' then 'Rejected' else 'Offer' end
    as applied_status,
  case when e.id is null then p.notes when e.st = 'O' then null else 'line ' || e.st end as notes,
  case when e.id is null then p.resume_generated else e.disc > 0.05 end as resume_generated
from fx_postings p left join edits e on p.id = e.id""")
def snk3(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    cols = (
        F.when(F.col("l_returnflag") == "R", "Rejected").otherwise("Offer").alias("applied_status"),
        F.when(F.col("l_linestatus") == "O", None).otherwise(
            F.concat(F.lit("line "), "l_linestatus")).alias("notes"),
        (F.col("l_discount") > 0.05).alias("resume_generated"))
    edits = lines.filter("l_returnflag <> 'N'").select(
        
        F.col("l_orderkey").alias("id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("edit_no"), *cols)
    unknown = lines.select(
        (-1 - F.col("l_orderkey")).alias("id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("edit_no"), *cols)
    return store.apply_edits(fx.postings(spark, sf), edits.unionByName(unknown)).select(
        "id", "applied_status", "notes", "resume_generated")


@query("snk4_retention", using="fx_postings", sql="""
select id, date_found from fx_postings where date_found >= date '2001-08-01' - 30""")
def snk4(spark, sf):
    return store.retain(fx.postings(spark, sf), F.to_date(F.lit(fx.AS_OF))).select("id", "date_found")


@query("snk4_deleted_count", using="fx_postings", sql="""
select count(*) as deleted from fx_postings where date_found < date '2001-08-01' - 30""")
def snk4b(spark, sf):
    return store.expired(fx.postings(spark, sf), F.to_date(F.lit(fx.AS_OF))).agg(
        F.count("*").alias("deleted"))


@query("snk7_alert_messages", using="fx_records fx_history", sql=f"""
with firsts as (select url, min(doc_id) as doc_id from fx_records
  where {sql_any('lower(text)', KEYWORDS, lower=True)} group by url)
select r.company, r.url, '🚨 **NEW JOB MATCH FOUND!**' || chr(10) || '**Company:** ' || r.company || chr(10)
  || '**Keywords:** ' || array_to_string({sql_hits('lower(r.text)', KEYWORDS)}, ', ') || chr(10)
  || '**Title:** ' || r.title || chr(10) || '**URL:** ' || r.url || chr(10)
  || '**Found:** 2024-01-31 08:30:00' as message
from firsts f join fx_records r on r.doc_id = f.doc_id where f.url not in (select url from fx_history)""")
def snk7(spark, sf):
    docs = fx.records(spark, sf).withColumn("keywords", F.array(*[F.lit(k) for k in KEYWORDS]))
    matches = rules.with_matched_keywords(docs, F.col("text"))
    new = store.new_rows(matches, fx.history(spark, sf), ["doc_id"])
    return store.alert_messages(new, F.to_timestamp(F.lit("2024-01-31 08:30:00")))


@query("snk5_export_view", using="fx_records", sql=f"""
with firsts as (select url, min(doc_id) as doc_id from fx_records
  where {sql_any('lower(text)', KEYWORDS, lower=True)} group by url)
select r.company, r.title, r.url, array_to_string({sql_hits('lower(r.text)', KEYWORDS)}, ', ') as matched_keywords,
  'Pending' as applied_status, false as resume_generated
from firsts f join fx_records r on r.doc_id = f.doc_id""")
def snk5(spark, sf):
    docs = fx.records(spark, sf).withColumn("keywords", F.array(*[F.lit(k) for k in KEYWORDS]))
    unique = dedup.dedup_by_url(rules.with_matched_keywords(docs, F.col("text")), ["doc_id"])
    shaped = store.as_postings(
        unique, F.to_timestamp(F.lit("2024-01-31 00:00:00")), matched=F.col("matched_keywords"))
    return store.export_view(shaped).select(
        "company", "title", "url", "matched_keywords", "applied_status", "resume_generated")


@query("ag9_save_summary", using="fx_records fx_history", sql="""
with t as (select count(*) as matches, count(distinct case when url not in (select url from fx_history)
  then url end) as added from fx_records)
select matches, added, matches - added as duplicates from t""")
def ag9(spark, sf):
    batch = fx.records(spark, sf).select("doc_id", "url")
    return report.save_summary(store.tag_new(batch, fx.history(spark, sf), ["doc_id"]))


@query("st1_union_phases", using="fx_records", sql="""
select 'sites' as phase, 0 as phase_no, doc_id, lang, null as title from fx_records where lang = 'de'
union all select 'generic', 1, doc_id, null, title from fx_records where lang = 'fr'
union all select 'boards', 2, doc_id, lang, title from fx_records where lang = 'es'""")
def st1(spark, sf):
    from careerlens.plans.scored_scan import all_phases

    rows = fx.records(spark, sf)
    return all_phases(
        sites=rows.filter("lang = 'de'").select("doc_id", "lang"),
        generic=rows.filter("lang = 'fr'").select("doc_id", "title"),
        boards=rows.filter("lang = 'es'").select("doc_id", "lang", "title"),
    ).select("phase", "phase_no", "doc_id", "lang", "title")


@query("st2_difference", using="fx_records fx_history", sql="""
select distinct url from fx_records except select url from fx_history""")
def st2(spark, sf):
    urls_ = fx.records(spark, sf).select("url").distinct()
    return dedup.drop_known_urls(urls_, fx.history(spark, sf))


@query("st3_list_concat", using="fx_records", sql="""
select doc_id, array_to_string(list_concat(['2026', 'class of 2026'], [company, lang]), '|') as terms
from fx_records""")
def st3(spark, sf):
    from careerlens.lexicon import YEAR_TERMS
    from careerlens.operators.small_tables import array_literal

    terms = F.concat(array_literal(YEAR_TERMS), F.array("company", "lang"))
    return fx.records(spark, sf).select("doc_id", F.array_join(terms, "|").alias("terms"))


@query("ag11_distinct_preview", using="fx_postings", sql="""
with m as (select date_trunc('month', date_found) as month, count(*) as n, count(distinct title) as titles,
  count(distinct url) as urls from fx_postings group by 1)
select cast(month as date) as month, n, titles, urls, true as titles_near, true as urls_near from m""")
def ag11_preview(spark, sf):
    # estimates of each month from the sketches of its days, beside the exact counts
    rows = fx.postings(spark, sf)
    days = report.daily_sketches(rows, "title", "url").withColumn("month", F.trunc("day", "month"))
    preview = report.distinct_preview(days, "title", "url", keys=("month",))
    exact = rows.groupBy(F.trunc("date_found", "month").alias("month")).agg(
        F.countDistinct("title").alias("titles"), F.countDistinct("url").alias("urls"))
    near = lambda estimate, count: F.abs(F.col(estimate) - F.col(count)) <= 0.04 * F.col(count) + 1
    return preview.join(exact, "month").select(
        "month", "n", "titles", "urls", near("title", "titles").alias("titles_near"), near("url", "urls").alias("urls_near"))
