"""Scoring stages, whole flows and profile matching."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from careerlens.catalog.extraction import ANCHORS, ORIGIN
from careerlens.catalog.registry import SQL_BLANKS, query, sql_any, sql_hits, sql_list, sql_text
from careerlens.catalog.rules import LINKS, RULES
from careerlens.functions import urls
from careerlens.functions.text import document_key, safe_key
from careerlens.lexicon import CandidatePolicy, Lexicon, SiteRule, SourcePolicy
from careerlens.operators import profile_match as pm
from careerlens.operators import score as sc
from careerlens.operators import store
from careerlens.operators.anchors import titled_anchors
from careerlens.operators.dedup import dedup_by_url, drop_known_urls
from careerlens.plans import keyword_scan, scored_flow, scored_scan, site_records
from careerlens.session import scratch_folder
from careerlens.sources import standins as fx
from careerlens.sources import tables as src

LEX = Lexicon(
    required=("the", "and", "with"), deal_breakers=("Apache",),
    entry_level=("that", "this", "From", "for"),
    penalties=(("license", -0.30), ("was", -0.35), ("thth", -0.10)),
    doctorate_preferred=("ndre ", "heed "), masters_preferred=("eres ", "ouea "),
    bachelor=("hewh", "tiin"), domain=("ing", "tion", "ble", "Are", "ther"))
BOARD = replace(LEX, required=("with", "from"))


def _num(x: float) -> str:
    return f"{x!r}::double"


def stages_sql(lex: Lexicon, rel: str, key: str = "doc_id") -> str:
    """CTEs low -> stages -> scored over ``rel(key, text, embedding)``."""
    required = f"not {sql_any('t', lex.required)}" if lex.required else "false"
    pens = lex.penalties if lex.penalty_mode == "first" else sorted(lex.penalties, key=lambda p: p[1])
    weight = " ".join(f"when contains(t, {sql_text(w.lower())}) then {_num(v)}" for w, v in pens)
    label = " ".join(f"when contains(t, {sql_text(w.lower())}) then {sql_text(w)}" for w, _ in pens)
    return f"""
  prof as (select embedding::double[] as pv from embeddings where vec_id = 0),
  low as (select *, lower(text) as t, embedding::double[] as v from {rel}),
  rejected as (
    select *, case when {required} then 'no_required_keyword'
      when {sql_any('t', lex.deal_breakers, lower=True)} then 'deal_breaker' end as reject_reason from low),
  hits as (
    select *, case when reject_reason is null then {sql_hits('t', lex.entry_level)} else [] end as entry_list,
      case when reject_reason is null then len({sql_hits('t', lex.domain)}) else 0 end as domain_hits,
      case when reject_reason is null then case {weight} else 0.0 end else 0.0 end::double as penalty,
      case when reject_reason is null then case {label} end end as penalty_term,
      case when reject_reason is null then case
        when {sql_any('t', lex.doctorate_preferred)} then {_num(lex.doctorate_weight)}
        when {sql_any('t', lex.masters_preferred)} then {_num(lex.masters_weight)} else 0.0 end
        else 0.0 end::double as degree,
      case when reject_reason is null and {sql_any('t', lex.bachelor)} then {_num(lex.bachelor_weight)}
        else 0.0 end::double as bachelor,
      case when reject_reason is null then list_inner_product(v, pv)
        / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(pv, pv))) end as similarity
    from rejected, prof),
  stages as (
    select *, len(entry_list) as entry_hits,
      least(0.15::double, len(entry_list) * 0.05::double) as entry_boost,
      least(0.2::double, domain_hits * 0.05::double) as domain_boost from hits),
  scored as (
    select *, case when reject_reason is not null then 0.0
      when similarity is not null then greatest(0.0::double, least(1.0::double,
        similarity + entry_boost + penalty + degree + bachelor + domain_boost)) end::double as score
    from stages)
"""


_INPUT_SQL = """
  scored_input as (select r.*, e.embedding from fx_records r left join embeddings e on e.vec_id = r.doc_id)
"""
_STAGES = f"{_INPUT_SQL}, {stages_sql(LEX, 'scored_input')}"


def _stages(spark, sf):
    return sc.with_stages(fx.records(spark, sf), LEX)


def _scored(spark, sf, lex=LEX, explain=False):
    return sc.score(fx.scored_input(spark, sf), fx.profile(spark, sf), lex, explain=explain)


@query("sc1_required", using="fx_records", sql=f"""
select doc_id, {sql_any('lower(text)', LEX.required)} as has_required,
  {sql_any('lower(text)', ('The', 'And'))} as mixed_case_never_hits from fx_records""")
def sc1(spark, sf):
    low = F.lower("text")
    def missing(words):
        return sc.reject_reason(low, replace(LEX, required=words, deal_breakers=())).isNull()

    return fx.records(spark, sf).select(
        "doc_id", missing(LEX.required).alias("has_required"),
        missing(("The", "And")).alias("mixed_case_never_hits"))


@query("sc2_deal_breakers", using="fx_records", sql=f"""
with {_STAGES} select doc_id, reject_reason from stages""")
def sc2(spark, sf):
    return _stages(spark, sf).select("doc_id", "reject_reason")


@query("sc3_cosine", using="fx_records", sql=f"""
with {_STAGES} select doc_id, round(similarity, 6) as similarity from stages""")
def sc3(spark, sf):
    return _scored(spark, sf).select("doc_id", F.round("similarity", 6).alias("similarity"))


@query("sc4_entry_boost", using="fx_records", sql=f"""
with {_STAGES} select doc_id, cast(entry_hits as int) as entry_hits, round(entry_boost, 6) as entry_boost
from stages""")
def sc4(spark, sf):
    return _stages(spark, sf).select("doc_id", "entry_hits", F.round("entry_boost", 6).alias("entry_boost"))


@query("sc5_seniority_penalty", using="fx_records", sql=f"""
with {_STAGES} select doc_id, penalty, penalty_term from stages""")
def sc5(spark, sf):
    return _stages(spark, sf).select("doc_id", "penalty", "penalty_term")


_STRONG = replace(LEX, penalty_mode="strongest")


@query("sc5_strongest_penalty", using="fx_records", sql=f"""
with {_INPUT_SQL}, {stages_sql(_STRONG, 'scored_input')} select doc_id, penalty, penalty_term from stages""")
def sc5b(spark, sf):
    return sc.with_stages(fx.records(spark, sf), _STRONG).select("doc_id", "penalty", "penalty_term")


@query("sc6_degree_preference", using="fx_records", sql=f"""
with {_STAGES} select doc_id, degree from stages""")
def sc6(spark, sf):
    return _stages(spark, sf).select("doc_id", "degree")


@query("sc7_bachelor_boost", using="fx_records", sql=f"""
with {_STAGES} select doc_id, bachelor from stages""")
def sc7(spark, sf):
    return _stages(spark, sf).select("doc_id", "bachelor")


@query("sc8_domain_boost", using="fx_records", sql=f"""
with {_STAGES} select doc_id, cast(domain_hits as int) as domain_hits, round(domain_boost, 6) as domain_boost
from stages""")
def sc8(spark, sf):
    return _stages(spark, sf).select("doc_id", "domain_hits", F.round("domain_boost", 6).alias("domain_boost"))


@query("sc9_score", using="fx_records", sql=f"""
with {_STAGES} select doc_id, reject_reason, round(score, 6) as score from scored""")
def sc9(spark, sf):
    return _scored(spark, sf).select("doc_id", "reject_reason", F.round("score", 6).alias("score"))


@query("sc10_explanation", using="fx_records", sql=f"""
with {_STAGES} select doc_id, array_to_string(list_filter([
  case when entry_hits > 0 then printf('%+.2f', entry_boost) || ' entry-level ('
    || array_to_string(entry_list[1:2], ', ') || ')' end,
  case when penalty_term is not null then printf('%+.2f', penalty) || ' seniority (' || penalty_term || ')' end,
  case when degree < -0.07 then '-0.10 PhD preferred (not required)'
    when degree < 0 then '-0.05 Masters preferred' end,
  case when bachelor > 0 then '+0.08 bachelor''s level' end,
  case when domain_hits > 0 then printf('%+.2f', domain_boost) || ' keywords (' || domain_hits || ' matches)' end
  ], lambda x: x is not null), ' | ') as adjustments, round(score, 6) as score from scored""")
def sc10(spark, sf):
    return _scored(spark, sf, explain=True).select(
        "doc_id", F.array_join("adjustments", " | ").alias("adjustments"), F.round("score", 6).alias("score"))


TITLE_TERMS = ("the and", "eau", "ich")


@query("sc11_site_record_policy", using="fx_records", sql=f"""
with {_INPUT_SQL}, {stages_sql(replace(LEX, required=()), 'scored_input')},
named as (select *, {sql_any('lower(title)', TITLE_TERMS)} as title_hit from scored),
policy as (select doc_id, title_hit, case when title_hit then 0.5 else score end::double as score from named)
select doc_id, title_hit, round(score, 6) as score from policy where title_hit or score >= 0.25""")
def sc11(spark, sf):
    kept = sc.score_site_records(
        fx.scored_input(spark, sf), fx.profile(spark, sf), LEX, title_terms=TITLE_TERMS)
    return kept.select("doc_id", "title_hit", F.round("score", 6).alias("score"))


GENERIC_POLICY = SourcePolicy(LEX, 0.35)
BOARD_POLICY = SourcePolicy(BOARD, 0.30, 12)


@query("sc12_source_policy", using="fx_records", sql=f"""
with {_INPUT_SQL},
a_in as (select * from scored_input where company like 'src1%'),
b_in as (select * from scored_input where company not like 'src1%'),
board as (with {stages_sql(BOARD, 'a_in')} select * from scored where score >= 0.30),
generic as (with {stages_sql(LEX, 'b_in')} select * from scored where score >= 0.35)
select 'board' as source_kind, doc_id, round(score, 6) as score from board
union all select 'generic', doc_id, round(score, 6) from generic""")
def sc12(spark, sf):
    rows, profile = fx.scored_input(spark, sf), fx.profile(spark, sf)
    is_board = F.col("company").startswith("src1")
    parts = [
        sc.above_threshold(sc.score(rows.filter(cond), profile, p.lexicon), p.threshold).select(
            F.lit(kind).alias("source_kind"), "doc_id", F.round("score", 6).alias("score"))
        for kind, cond, p in (("board", is_board, BOARD_POLICY), ("generic", ~is_board, GENERIC_POLICY))]
    return parts[0].unionByName(parts[1])


@query("pr11_score_threshold", using="fx_records", sql=f"""
with {_STAGES} select doc_id, round(score, 6) as score from scored where score >= 0.4""")
def pr11(spark, sf):
    return sc.above_threshold(_scored(spark, sf), 0.4).select("doc_id", F.round("score", 6).alias("score"))


@query("sl3_first_entry_terms", using="fx_records", sql=f"""
with {_STAGES} select doc_id, array_to_string(entry_list[1:2], ', ') as entry_terms from stages
where entry_hits > 0""")
def sl3(spark, sf):
    rows = _stages(spark, sf).filter("entry_hits > 0")
    return rows.select("doc_id", F.array_join("entry_terms", ", ").alias("entry_terms"))


@query("wn6_first_penalty", using="fx_records", sql=f"""
with {_STAGES} select penalty_term, count(*) as n from stages where penalty_term is not null group by 1""")
def wn6(spark, sf):
    rows = _stages(spark, sf).filter(F.col("penalty_term").isNotNull())
    return rows.groupBy("penalty_term").agg(F.count("*").alias("n"))


@query("ux4_tuned_lexicon", using="fx_records", sql=f"""
with {_INPUT_SQL}, {stages_sql(replace(LEX, required=('die', 'und')), 'scored_input')}
select doc_id, round(score, 6) as score from scored where score >= 0.1""")
def ux4(spark, sf):
    tuned = replace(LEX, required=("die", "und"))
    return sc.above_threshold(_scored(spark, sf, tuned), 0.1).select("doc_id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------- flows

_FLAG_KEYWORDS = ("The", "und", "que", "ich", "ion")
_MATCH_SQL = f"""
  {ANCHORS}, links as (select *, {ORIGIN} || href as url from anchors),
  hits as (
    select *, {sql_hits('lower(anchor_text)', _FLAG_KEYWORDS)} as hit from links
    where not {sql_any('lower(url)', LINKS.url_exclusions)} and length(anchor_text) >= 3),
  ranked as (
    select *, row_number() over (partition by site, url order by page_id, pos) as rn from hits where len(hit) > 0),
  matches as (select * from ranked where rn = 1)
"""


def _scan_pages(spark, sf):
    return fx.pages(spark, sf).withColumnRenamed("site", "company").withColumnRenamed("url", "page_url") \
        .withColumn("keywords", F.array(*[F.lit(k) for k in _FLAG_KEYWORDS]))


@query("flagship_matches_per_site", using="fx_pages", sql=f"""
with {_MATCH_SQL} select site as company, count(*) as n from matches group by site""")
def flagship(spark, sf):
    return keyword_scan.matches_per_site(keyword_scan.native_matches(_scan_pages(spark, sf), LINKS))


@query("keyword_scan_matches", using="fx_pages", sql=f"""
with {_MATCH_SQL}
select site as company, page_id, pos, anchor_text as title, url, array_to_string(hit, '|') as matched from matches""")
def scan_native(spark, sf):
    rows = keyword_scan.native_matches(_scan_pages(spark, sf), LINKS)
    return rows.withColumn("matched", F.array_join("matched_keywords", "|")).drop("matched_keywords")


@query("keyword_scan_context", using="fx_pages", sql=f"""
with {_MATCH_SQL}
select site as company, page_id, pos, anchor_text as title, url, array_to_string(hit, '|') as matched from matches""")
def scan_context(spark, sf):
    # in the test pages a link's parent holds nothing but the link
    rows = keyword_scan.context_matches(_scan_pages(spark, sf), LINKS)
    return rows.withColumn("matched", F.array_join("matched_keywords", "|")).drop("matched_keywords")


@query("snk2_run_rows", using="fx_pages", sql=f"""
with {_MATCH_SQL}, c as (select site, count(*) as n from matches group by site),
  p as (select distinct site from fx_pages union select 'down.example.org' union select 'none.example.org')
select 'Company ' || p.site as company, timestamp '2024-01-31 00:00:00' as ts,
  case when p.site like 'down.%' or p.site like 'none.%' then 'Error' else 'Success' end as status,
  cast(coalesce(n, 0) as int) as postings_found,
  case when p.site like 'down.%' then 'HTTP 503' when p.site like 'none.%' then 'no page landed' end as error_message
from p left join c using (site)""")
def snk2(spark, sf):
    # companies are named otherwise than their sites; beside the landed sites one failed and one has no page
    down = spark.createDataFrame([("down.example.org", "HTTP 503")], "site string, fetch_error string")
    landed = fx.pages(spark, sf).select("site", F.lit(None).cast("string").alias("fetch_error")).unionByName(down)
    found = keyword_scan.native_matches(
        _scan_pages(spark, sf).withColumn("company", F.concat(F.lit("Company "), "company")), LINKS)
    none = spark.createDataFrame([("none.example.org",)], "site string")
    targets = landed.select("site").distinct().unionByName(none).withColumn("company", F.concat(F.lit("Company "), "site"))
    rows = keyword_scan.run_rows(
        targets, keyword_scan.fetch_outcomes(landed), found, F.to_timestamp(F.lit("2024-01-31 00:00:00")), "no page landed")
    return rows.select(
        "company", F.col("ts").cast("timestamp_ntz").alias("ts"), "status", "postings_found", "error_message")


@query("ux1_plugin_records", using="fx_pages", sql=f"""
with {ANCHORS}, r as (
  select site as company, anchor_text as title, {ORIGIN} || href as url, page_id, pos from anchors
  where length(anchor_text) between 3 and 300),
k as (select *, row_number() over (partition by company, url order by page_id, pos) as rn from r)
select company, title, url, md5(company || '|' || url) as id from k where rn = 1""")
def ux1(spark, sf):
    # a site extractor of one's own: every link of every landed page is a record
    def list_items(pages):
        links = titled_anchors(pages.withColumnRenamed("url", "page_url"))
        return urls.with_record_url(links, "href", "page_url", "url").select(
            F.col("site").alias("company"), F.col("anchor_title").alias("title"), "url",
            F.col("anchor_title").alias("text"), F.lit("").alias("location"), F.struct("page_id", "pos").alias("ord"))

    return site_records.run_all(fx.pages(spark, sf), {"list_items": list_items}).select(
        "company", "title", "url", "id")


# Every page once for each built-in extractor, its list items rewritten to that site's cards.
_CARD_FORMS = {
    "line": ('<div class="course-item">', "", "</a></div>", "/"), "mercari": ('<div class="opening">', " engineer", '</a><span class="location">Tokyo</span></div>', "/"),
    "woven": ('<div class="opening">', " Intern", "</a></div>", "/"), "sony": ('<li class="css-9">', "", "</a></li>", "/"),
    "bytedance": ('<div class="jobCard-1">', " Research", "</a></div>", "https://jobs.example.com/"),
    "toshiba": ("<li>", " and more than twenty", "</a></li>", "/toshiba/jobs/"), "preferred": ("<li>", " graduate place", "</a></li>", "/recruit/")}
_LINK_ATTRIBUTES = {"sony": ' data-automation-id="jobTitle"', "bytedance": ' class="jobTitle"'}


def _site_pages(spark, sf):
    pages = fx.pages(spark, sf)
    out = None
    for key, (start, tail, end, root) in _CARD_FORMS.items():
        html = F.replace(F.col("html"), F.lit('<li><a href="/'), F.lit(f'{start}<a{_LINK_ATTRIBUTES.get(key, "")} href="{root}'))
        html = F.replace(html, F.lit("</a></li>"), F.lit(tail + end))
        rows = pages.select("page_id", F.lit(key).alias("site"), "url", html.alias("html"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _site_rows_sql(key):
    start, tail, end, root = _CARD_FORMS[key]
    name = site_records.NAMES[key]
    word = f"anchor_text || {sql_text(tail)}"
    keep = {"line": f"length(anchor_text) > 5 and not {sql_any('upper(anchor_text)', site_records.COURSE_SKIP)}",
            "toshiba": f"length({word}) >= 20", "preferred": f"not {sql_any(f'lower({word})', site_records.CAREER_SKIP)}"}.get(key, "true")
    url = f"{sql_text(root)} || substr(href, 2)" if root.startswith("http") else f"{ORIGIN} || {sql_text(root)} || substr(href, 2)"
    return (f"select {sql_text(key)} as site, {sql_text(name)} as company, {word} as title, {url} as url, "
            f"{sql_text('Tokyo') if key == 'mercari' else sql_text('')} as location, page_id, pos from anchors where {keep}")


@query("ux1_built_in_extractors", using="fx_pages", sql=f"""
with {ANCHORS}, r as ({" union all ".join(_site_rows_sql(k) for k in _CARD_FORMS)}),
k as (select *, row_number() over (partition by site, url order by page_id, pos) as rn from r where length(title) between 3 and 300)
select site, company, title, url, location, md5(company || '|' || url) as id from k where rn = 1""")
def ux1_built_in(spark, sf):
    chosen = {k: site_records.BUILT_IN[k] for k in _CARD_FORMS}
    return site_records.run_all(_site_pages(spark, sf), chosen).select("site", "company", "title", "url", "location", "id")


@query("ux2_rule_exceptions", using="fx_pages", sql=f"""
with {ANCHORS}, l as (select *, {ORIGIN} || href as url, lower(anchor_text) as t from anchors),
r as (
  select *, site = 'thther.example.org' as bypass,
    site = 'blog.tionsh.example.net' and contains(t, 'a') or site = 'm.ththth.example.net'
      and (contains(t, 'i') or contains(t, 'o')) as allowed from l),
k as (
  select *, row_number() over (partition by site, url order by page_id, pos) as rn from r
  where (bypass or allowed or length(t) >= 15) and not {sql_any('t', CandidatePolicy().text_exclusions)}
    and not {sql_any('lower(url)', CandidatePolicy().url_exclusions)}
    and not list_contains({sql_list(CandidatePolicy().button_labels + CandidatePolicy().category_labels)}, t)
    and contains(url, 'example') and (allowed or {sql_any('t', CandidatePolicy().role_terms + ('on', 'er'), lower=True)})
    and not (not bypass and not allowed and {sql_any('t', CandidatePolicy().skip_title_terms)}))
select site as company, page_id, pos, anchor_text as title, url from k where rn = 1""")
def ux2(spark, sf):
    policy = replace(CandidatePolicy(), posting_url_terms=("example",),
                     role_terms=CandidatePolicy().role_terms + ("on", "er"))
    return scored_scan.link_candidates(_scan_pages(spark, sf), policy, RULES)


# Listing and detail pages made from every record: one link and one detail page each.
SCAN_POLICY = replace(CandidatePolicy(), posting_url_terms=("jobs.example",), role_terms=("th", "on", "en"))
SCAN_RULES = (SiteRule("src7", max_links=4), SiteRule("src8", bypass_title_skip=True, max_links=40))


def _escaped(c):
    out = c
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def _listing(spark, sf):
    rows = fx.records(spark, sf)
    html = F.concat(F.lit('<html><body><p><a href="'), "url", F.lit('"> '), _escaped(F.col("title")),
                    F.lit(" </a></p></body></html>"))
    return rows.select(F.col("doc_id").alias("page_id"), "company",
                       F.concat(F.lit("https://list.example.org/"), "company").alias("page_url"), html.alias("html"))


def _details(spark, sf):
    from careerlens.operators.dedup import dedup_by_url

    rows = dedup_by_url(fx.scored_input(spark, sf), ["doc_id"])
    html = F.concat(F.lit("<html><body><nav>menu</nav><main>"), _escaped(F.col("text")), F.lit("</main></body></html>"))
    return rows.select("url", html.alias("html"), "embedding")


@query("scored_scan_matches", using="fx_records fx_history", sql=f"""
with c as (
  select doc_id, company, trim(title, ' ' || chr(10)) as title, url, lower(trim(title, ' ' || chr(10))) as t
  from fx_records),
valid as (
  select *, row_number() over (partition by company, url order by doc_id) as rn from c
  where (company = 'src8' or length(t) >= 15 and not {sql_any('t', SCAN_POLICY.skip_title_terms)})
    and not {sql_any('lower(url)', SCAN_POLICY.url_exclusions)}
    and not {sql_any('t', SCAN_POLICY.text_exclusions)}
    and not list_contains({sql_list(SCAN_POLICY.button_labels + SCAN_POLICY.category_labels)}, t)
    and {sql_any('t', SCAN_POLICY.role_terms)}),
capped as (
  select *, row_number() over (partition by company order by doc_id) as place from valid where rn = 1),
chosen as (
  select company, title, url from capped
  where place <= case company when 'src7' then 4 when 'src8' then 40 else 30 end
    and url not in (select url from fx_history)),
firsts as (select url, min(doc_id) as doc_id from fx_records group by url),
details as (
  select c.company, c.title, c.url, trim(r.text, ' ' || chr(10)) as text, e.embedding
  from chosen c join firsts f using (url) join fx_records r on r.doc_id = f.doc_id
  left join embeddings e on e.vec_id = f.doc_id where length(trim(r.text, ' ' || chr(10))) >= 200),
{stages_sql(LEX, 'details')}
select company, title, url, round(score, 6) as match_score,
  trim(substring(text, 1, 250), ' ' || chr(10)) as snippet from scored where score >= 0.35""")
def scan_scored(spark, sf):
    found = scored_scan.scan(
        _listing(spark, sf), _details(spark, sf), src.seen_keys(fx.history(spark, sf)), fx.profile(spark, sf),
        GENERIC_POLICY, SCAN_POLICY, SCAN_RULES)
    return found.withColumn("match_score", F.round("match_score", 6))


# Records in German are those of site extractors, the rest is listed; companies from src1 on are boards. Every third
# record has the address of the one before it, so phases and companies meet in one url.
FLOW_POLICY = scored_flow.FlowPolicy(
    {"generic": SourcePolicy(LEX, 0.2), "boards": SourcePolicy(replace(LEX, required=("in", "de")), 0.1, 12)},
    SCAN_POLICY, SCAN_RULES, LEX, TITLE_TERMS)


def _flow_rows(spark, sf):
    rows = fx.records(spark, sf)
    kind = F.when(F.col("lang") == "de", "sites").when(F.col("company").startswith("src1"), "boards").otherwise("generic")
    owner = F.col("doc_id") - F.when(F.col("doc_id") % 3 == 1, 1).otherwise(0)
    return rows.select("doc_id", "company", "title", "text", kind.alias("kind"),
                       F.concat(F.lit(fx.URL_ROOT), owner).alias("url"),
                       F.regexp_extract("company", "([0-9]+)", 1).cast("int").alias("source_no"))


def flow_pages(spark, sf):
    """Landed pages of all kinds: kind, page_id, company, source_no, url, html. A site page holds its one record."""
    html = F.concat(F.lit('<html><body><p><a href="'), "url", F.lit('"> '), _escaped(F.col("title")), F.lit(" </a></p></body></html>"))
    return _flow_rows(spark, sf).select(
        "kind", F.col("doc_id").alias("page_id"), "company", "source_no",
        F.concat(F.lit("https://list.example.org/"), "company").alias("url"), html.alias("html"))


def flow_details(spark, sf):
    rows = _flow_rows(spark, sf)
    first = rows.groupBy("url").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("d")).select("url", "d.*")
    html = F.concat(F.lit("<html><body><nav>menu</nav><main>"), _escaped(F.col("text")), F.lit("</main></body></html>"))
    return first.join(fx.vectors(spark, sf), "doc_id", "left").select("url", html.alias("html"), "embedding")


def flow_records(spark, sf):
    """What the site extractors give: the record of every site page, by its page."""
    texts = _flow_rows(spark, sf).select(F.col("doc_id").alias("page_id"), "title", "text", F.col("url").alias("record_url"))
    vectors = fx.vectors(spark, sf).withColumnRenamed("doc_id", "page_id")

    def extract(pages):
        return pages.select("page_id", "company", "source_no").join(texts, "page_id").join(vectors, "page_id", "left").select(
            "company", "title", F.col("record_url").alias("url"), "text", "embedding", "source_no",
            F.struct("page_id", F.lit(1).alias("pos")).alias("ord"))

    return extract


def _flow_matches(spark, sf):
    pages = flow_pages(spark, sf)
    listings = {k: pages.where(F.col("kind") == k).withColumnRenamed("url", "page_url") for k in FLOW_POLICY.listings}
    history = _flow_history(spark, sf)
    return scored_flow.scan_matches(
        flow_records(spark, sf)(pages.where("kind = 'sites'")), listings, flow_details(spark, sf),
        lambda rows: drop_known_urls(rows, history), fx.profile(spark, sf), FLOW_POLICY)


def _flow_history(spark, sf):
    """Addresses of records labelled good."""
    good = fx.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return _flow_rows(spark, sf).join(good, "doc_id", "left_semi").select("url").distinct()


_FLOW_SQL = f"""
  flow as (
    select doc_id, company, title, text, case when lang = 'de' then 'sites' when starts_with(company, 'src1') then 'boards'
      else 'generic' end as kind, 'https://jobs.example.com/' || (doc_id - case when doc_id % 3 = 1 then 1 else 0 end) as url,
      cast(regexp_extract(company, '([0-9]+)', 1) as int) as source_no from fx_records),
  old as (select distinct url from flow join labels using (doc_id) where quality = 1),
  own as (
    select f.doc_id, f.company, trim(title, {SQL_BLANKS}) as title, url, case when text = '' then trim(title, {SQL_BLANKS}) else text end as text,
      source_no, embedding from flow f left join embeddings e on e.vec_id = f.doc_id
    where kind = 'sites' and trim(title, {SQL_BLANKS}) <> '' and url not in (select url from old)),
  site_rows as (with {stages_sql(replace(LEX, required=()), 'own')}
    select *, {sql_any('lower(title)', TITLE_TERMS)} as title_hit from scored),
  site_found as (
    select 'sites' as phase, 0 as phase_no, company, title, url, case when title_hit then 0.5 else score end::double as match_score,
      trim(substring(text, 1, 250), {SQL_BLANKS}) as snippet, source_no, doc_id from site_rows where title_hit or score >= 0.25),
  c as (
    select doc_id, company, kind, source_no, trim(title, {SQL_BLANKS}) as title, url, lower(trim(title, {SQL_BLANKS})) as t
    from flow where kind <> 'sites'),
  valid as (
    select *, row_number() over (partition by kind, company, url order by doc_id) as rn from c
    where (company = 'src8' or length(t) >= 15 and not {sql_any('t', SCAN_POLICY.skip_title_terms)})
      and not {sql_any('lower(url)', SCAN_POLICY.url_exclusions)}
      and not {sql_any('t', SCAN_POLICY.text_exclusions)}
      and not list_contains({sql_list(SCAN_POLICY.button_labels + SCAN_POLICY.category_labels)}, t)
      and {sql_any('t', SCAN_POLICY.role_terms)}),
  capped as (select *, row_number() over (partition by kind, company order by doc_id) as place from valid where rn = 1),
  chosen as (
    select kind, company, title, url, source_no, doc_id from capped
    where place <= case company when 'src7' then 4 when 'src8' then 40 else case kind when 'boards' then 12 else 30 end end
      and url not in (select url from old)),
  firsts as (select url, min(doc_id) as first_id from flow group by url),
  pages2 as (
    select c.*, trim(f2.text, {SQL_BLANKS}) as text, e.embedding from chosen c join firsts f using (url)
    join flow f2 on f2.doc_id = f.first_id left join embeddings e on e.vec_id = f.first_id
    where length(trim(f2.text, {SQL_BLANKS})) >= 200),
  g_in as (select * from pages2 where kind = 'generic'),
  b_in as (select * from pages2 where kind = 'boards'),
  listed as (
    select 'generic' as phase, 1 as phase_no, * from (with {stages_sql(LEX, 'g_in')} select * from scored where score >= 0.2)
    union all by name
    select 'boards' as phase, 2 as phase_no, * from (with {stages_sql(replace(LEX, required=('in', 'de')), 'b_in')} select * from scored where score >= 0.1)),
  found as (
    select * from site_found union all
    select phase, phase_no, company, title, url, score, trim(substring(text, 1, 250), {SQL_BLANKS}), source_no, doc_id from listed),
  ranked2 as (
    select *, row_number() over (partition by url order by phase_no, source_no, doc_id, company) as rn from found),
  won as (select * from ranked2 where rn = 1)
"""


@query("scored_flow_postings", using="fx_records", sql=f"""
with {_FLOW_SQL}
select phase, company, title, url, round(match_score, 6) as match_score, snippet, md5(company || '|' || url) as id,
  'Pending' as applied_status from won""")
def scored_flow_postings(spark, sf):
    won = scored_flow.first_matches(_flow_matches(spark, sf))
    shaped = store.as_postings(won, F.to_timestamp(F.lit("2024-01-31 00:00:00")), score=F.col("match_score"),
                               carry=("phase", "snippet"))
    return shaped.select("phase", "company", "title", "url", F.round("match_score", 6).alias("match_score"), "snippet",
                         "id", "applied_status")


@query("scored_flow_summary", using="fx_records", sql=f"""
with {_FLOW_SQL}
select count(*) as matches, count(*) filter (url not in (select url from flow where doc_id % 5 = 0)) as added,
  count(*) filter (url in (select url from flow where doc_id % 5 = 0)) as duplicates from won""")
def scored_flow_summary(spark, sf):
    # the counts of a written run, of which another run stored every fifth record's address before the write
    root = scratch_folder(spark, "flow")
    at = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    others = dedup_by_url(_flow_rows(spark, sf).where("doc_id % 5 = 0"), ["doc_id"])
    store.insert_run(spark, root, store.as_postings(others, at), "other")
    _, counts = scored_flow.save_scan(_flow_matches(spark, sf), root, "scan", at)
    return spark.createDataFrame([tuple(counts[c] for c in ("matches", "added", "duplicates"))],
                                 "matches bigint, added bigint, duplicates bigint")


# -------------------------------------------------------- profile matching

SKILLS = {
    "languages": ("Tion", "Ich", "The", "Zeit"),
    "frameworks": ("eau", "and", "license"),
    "concepts": ("That", "Apache", "ung", "ment"),
}
PROJECTS = (
    pm.Project("Reed the with", ("that", "and"), ("In of this for", "Ther tion")),
    pm.Project("Eau les une", ("que", "des"), ("La pour avec",)),
    pm.Project("Ich und der", ("nicht", "mit"), ("Die von ein",)),
    pm.Project("License text", ("apache", "software"), ("Is it by or",)),
)
TEMPLATE = "S: {{SUMMARY_PLACEHOLDER}}\nP: {{PROJECTS_PLACEHOLDER}}\nK: {{SKILLS_PLACEHOLDER}}\n"
_WORDS = r"string_split_regex(lower(text), '[^\p{L}\p{N}+#]+')"


@query("tl1_taxonomy_terms", using="fx_records", sql=f"""
select doc_id, array_to_string({sql_hits('lower(text)', [s for v in SKILLS.values() for s in v])}, '|') as skill_terms
from fx_records""")
def tl1(spark, sf):
    every = [s for names in SKILLS.values() for s in names]
    rows = pm.taxonomy_terms(fx.records(spark, sf), every)
    return rows.select("doc_id", F.array_join("skill_terms", "|").alias("skill_terms"))


@query("tl1_top_terms", using="fx_records", sql=f"""
with w as (select doc_id, unnest({_WORDS}) as term from fx_records),
tf as (select doc_id, term, count(*) as tf from w where term <> '' group by all),
df as (select term, count(*) as df from tf group by term),
n as (select count(*) as n from fx_records),
rated as (select doc_id, term, tf, tf * ln(n / df::double) as tfidf from tf join df using (term), n),
ranked as (select *, row_number() over (partition by doc_id order by tfidf desc, term) as rank from rated)
select doc_id, term, tf, round(tfidf, 6) as tfidf, cast(rank as int) as rank from ranked where rank <= 5""")
def tl1b(spark, sf):
    return pm.top_terms(fx.records(spark, sf), "doc_id", 5)


_PROJECT_ROWS = ", ".join(
    f"({i}, {sql_text(p.title)}, {sql_list(p.terms())})" for i, p in enumerate(PROJECTS))


@query("tl2_rank_projects", using="fx_records", sql=f"""
with p as (select * from (values {_PROJECT_ROWS}) t(ord, project, terms)),
w as (select doc_id, list_distinct({_WORDS}) as words from fx_records),
rated as (
  select doc_id, ord, project, len(list_intersect(words, terms)) as shared_terms from w, p),
ranked as (select *, row_number() over (partition by doc_id order by shared_terms desc, ord) as rank from rated)
select doc_id, cast(rank as int) as rank, project, cast(shared_terms as int) as shared_terms
from ranked where rank <= 3""")
def tl2(spark, sf):
    return pm.rank_projects(fx.records(spark, sf), PROJECTS, "doc_id")


_SKILL_ROWS = ", ".join(
    f"({i}, {sql_text(c)}, {j}, {sql_text(s)})"
    for i, (c, names) in enumerate(SKILLS.items()) for j, s in enumerate(names))


@query("tl3_reorder_skills", using="fx_records", sql=f"""
with s as (select * from (values {_SKILL_ROWS}) t(category_no, category, ord, skill))
select doc_id, cast(category_no as int) as category_no, category,
  string_agg(skill, ', ' order by not contains(lower(text), lower(skill)), ord) as skills
from fx_records, s group by doc_id, category_no, category""")
def tl3(spark, sf):
    rows = pm.reorder_skills(fx.records(spark, sf), SKILLS, "doc_id")
    return rows.withColumn("skills", F.array_join("skills", ", "))


@query("tl4_fill_template", using="fx_records", sql=f"""
select doc_id, 'S: ' || title || chr(10) || 'P: ' || company || chr(10) || 'K: ' || lang || chr(10) as document
from fx_records""")
def tl4(spark, sf):
    doc = pm.fill_template(TEMPLATE, F.col("title"), F.col("company"), F.col("lang"))
    return fx.records(spark, sf).select("doc_id", doc.alias("document"))


@query("tl5_document_key", sql=r"""
select o_orderkey, replace(trim(regexp_replace(c_name || ' & ' || o_orderpriority, '[^a-zA-Z0-9_\s-]', '', 'g')), ' ', '_')
    as safe_role,
  replace(regexp_replace(c_mktsegment, '[^a-zA-Z0-9_\s-]', '', 'g'), ' ', '_') || '_'
  || replace(trim(regexp_replace(c_name || ' & ' || o_orderpriority, '[^a-zA-Z0-9_\s-]', '', 'g')), ' ', '_') || '_'
  || strftime(o_orderdate, '%Y%m%d_%H%M%S') as document_key
from orders join customer on o_custkey = c_custkey""")
def tl5(spark, sf):
    rows = fx.table(spark, sf, "orders").join(
        fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    role = F.concat(F.col("c_name"), F.lit(" & "), F.col("o_orderpriority"))
    return rows.select(
        "o_orderkey", safe_key(role).alias("safe_role"),
        document_key(F.col("c_mktsegment"), role, F.col("o_orderdate")).alias("document_key"))
