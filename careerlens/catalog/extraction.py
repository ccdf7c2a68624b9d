"""Sources, extraction and URL operators."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from careerlens.catalog.registry import SQL_BLANKS, query, sql_any, sql_list, sql_text
from careerlens.functions import urls
from careerlens.functions.markup import decode_references
from careerlens.functions.text import bounded, first_line_title, first_nonblank
from careerlens.lexicon import GRADUATE_TERMS, SectionPolicy
from careerlens.operators.anchors import text_anchors, titled_anchors
from careerlens.operators.dom import Pick, RecordRule, dom_links, extract_records, scoped_links
from careerlens.operators.keywords import keyword_hits
from careerlens.operators.main_text import main_text
from careerlens.operators.records import section_records, with_fallback_rows, with_section_title
from careerlens.sources import standins as fx
from careerlens.sources import tables as src

# Every anchor of every page, found without the package's own code.
ANCHORS = """
  raw as (
    select page_id, site, url as page_url,
      regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs,
      regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as texts
    from fx_pages),
  anchors as (
    select page_id, site, page_url, cast(i as int) as pos, hrefs[i] as href, trim(texts[i]) as anchor_text
    from (select *, unnest(range(1, len(hrefs) + 1)) as i from raw)
    where texts[i] <> '' and hrefs[i] <> '')
"""
ORIGIN = "regexp_extract(page_url, '^[a-z]+://[^/?#]+')"


# ----------------------------------------------------------------- sources

def _targets_of_pages(spark, sf):
    """One target per landed site, beside the configured ones."""
    sites = fx.pages(spark, sf).select("site").distinct().select(
        F.col("site").alias("company"),
        F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"),
        F.array(F.lit("The"), F.lit("une"), F.lit("ich")).alias("keywords"),
        F.when(F.col("site").startswith("blog."), 12).otherwise(24).alias("check_interval_hours"))
    return src.targets(spark).unionByName(sites)


_TARGET_ROWS = ", ".join(
    f"({sql_text(c)}, {sql_text(u)}, {sql_list(k)}, {h})" for c, u, k, h in src.TARGETS)
_BOARD_ROWS = ", ".join(f"({sql_text(n)}, {sql_text(u)})" for n, u in src.BOARDS)
_TARGETS_SQL = f"""
  targets as (
    select * from (values {_TARGET_ROWS}) t(company, url, keywords, check_interval_hours)
    union all
    select distinct site, 'https://' || site || '/', ['The', 'une', 'ich'],
      case when starts_with(site, 'blog.') then 12 else 24 end from fx_pages)
"""


@query("src1_targets", using="fx_pages", sql=f"""
with {_TARGETS_SQL}
select t.company, t.url, array_to_string(t.keywords, '|') as keywords,
  cast(t.check_interval_hours as int) as check_interval_hours, count(p.page_id) as pages
from targets t left join fx_pages p
  on p.site = regexp_extract(t.url, '^[a-z]+://([^/?#]+)', 1)
group by all""")
def src1(spark, sf):
    targets = _targets_of_pages(spark, sf).withColumn("site", urls.host_of(F.col("url")))
    counts = fx.pages(spark, sf).groupBy("site").agg(F.count("*").alias("pages"))
    return targets.join(counts, "site", "left").select(
        "company", "url", F.array_join("keywords", "|").alias("keywords"), "check_interval_hours",
        F.coalesce("pages", F.lit(0)).alias("pages"))


_SITE_ROWS = ", ".join(
    f"({sql_text(k)}, {sql_text(n)}, {sql_list(u)}, {w})" for k, n, u, _, w in src.SITES)


# The given pages lie on none of the configured hosts: beside the configured entries each landed host is one.
_HOST = "regexp_extract({}, '^[a-z]+://([^/?#]+)', 1)"


def _landed(spark, sf):
    return fx.pages(spark, sf).select("site").distinct()


def _pages_by_host(spark, sf, entries):
    """Entries with the number of pages on the host of their ``url``."""
    counts = fx.pages(spark, sf).groupBy(F.col("site").alias("__host")).agg(F.count("*").alias("pages"))
    rows = entries.join(counts, urls.host_of(F.col("url")) == F.col("__host"), "left")
    return rows.drop("__host").fillna(0, ["pages"])


@query("src2_site_registry", using="fx_pages", sql=f"""
with s as (
  select site_key, name, urls[1] as url, cast(wait_time as int) as wait_time
  from (values {_SITE_ROWS}) t(site_key, name, urls, wait_time)
  union all select distinct site, upper(site), 'https://' || site || '/', 1000 from fx_pages)
select s.*, count(p.page_id) as pages from s left join fx_pages p on p.site = {_HOST.format('s.url')} group by all""")
def src2(spark, sf):
    landed = _landed(spark, sf).select(
        F.col("site").alias("site_key"), F.upper("site").alias("name"),
        F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"), F.lit(1000).alias("wait_time"))
    entries = src.sites(spark).select("site_key", "name", "url", "wait_time").unionByName(landed)
    return _pages_by_host(spark, sf, entries)


@query("src3_page_input", sql="""
select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as site, count(*) as pages,
  cast(sum(length(html)) as bigint) as chars from pages group by 1""")
def src3(spark, sf):
    pages = src.read_pages(spark, f"{sf}/pages.parquet")
    return pages.groupBy(urls.host_of(F.col("url")).alias("site")).agg(
        F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query("src6_seen_keys", using="fx_records", sql="select distinct sha256(url) as seen_key from fx_records")
def src6(spark, sf):
    return src.seen_keys(fx.records(spark, sf))


_CAL_ROWS = ", ".join("(" + ", ".join(sql_text(v) for v in r) + ")" for r in src.CALENDAR)


@query("src8_calendar", using="fx_pages", sql=f"""
with cal as (
  select * from (values {_CAL_ROWS}) t(company, track, status, win, priority)
  union all select distinct site, 'Landed', 'Open', 'Any', 'Low' from fx_pages)
select c.company, c.track, c.status, c.win as "window", c.priority,
  case c.status when 'Open' then '🟢' when 'Upcoming' then '🟡' else '🔴' end as icon,
  count(p.page_id) as pages
from cal c left join fx_pages p on contains(lower(p.html), lower(c.company)) group by all""")
def src8(spark, sf):
    # pages that name the company of an entry, found in the whole page
    landed = _landed(spark, sf).select(
        F.col("site").alias("company"), F.lit("Landed").alias("track"), F.lit("Open").alias("status"),
        F.lit("Any").alias("window"), F.lit("Low").alias("priority"), F.lit("🟢").alias("icon"))
    entries = src.calendar(spark).unionByName(landed)
    hits = keyword_hits(fx.pages(spark, sf), entries, "page_id", "html", "company")
    counts = hits.groupBy("word").agg(F.count("*").alias("pages"))
    return entries.join(counts, F.lower("company") == F.col("word"), "left").drop("word").fillna(0, ["pages"])


@query("src9_all_sources", using="fx_pages", sql=f"""
with t as (
  select company, url, 'generic' as source_kind, keywords from (values {_TARGET_ROWS})
    t(company, url, keywords, h)
  union all select company, url, 'board', {sql_list(GRADUATE_TERMS)} from (values {_BOARD_ROWS}) b(company, url)
  union all select distinct site, 'https://' || site || '/', 'landed', ['The'] from fx_pages)
select t.source_kind, t.company, t.url, array_to_string(t.keywords, '|') as keywords,
  case t.source_kind when 'board' then 12 else 30 end as link_cap, count(p.page_id) as pages
from t left join fx_pages p on p.site = {_HOST.format('t.url')} group by all""")
def src9(spark, sf):
    from careerlens.lexicon import BOARD_LINK_CAP, DEFAULT_LINK_CAP

    landed = _landed(spark, sf).select(
        F.col("site").alias("company"), F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"),
        F.array(F.lit("The")).alias("keywords"), F.lit("landed").alias("source_kind"))
    every = src.all_targets(spark, GRADUATE_TERMS).unionByName(landed, allowMissingColumns=True)
    cap = F.when(F.col("source_kind") == "board", BOARD_LINK_CAP).otherwise(DEFAULT_LINK_CAP)
    return _pages_by_host(spark, sf, every).select(
        "source_kind", "company", "url", F.array_join("keywords", "|").alias("keywords"),
        cap.alias("link_cap"), "pages")


# -------------------------------------------------------------- extraction

@query("ex1_anchors", using="fx_pages", sql=f"""
with {ANCHORS} select page_id, pos, href, anchor_text from anchors""")
def ex1(spark, sf):
    return text_anchors(fx.pages(spark, sf)).select("page_id", "pos", "href", "anchor_text")


# Every name of the standard, with and without its semicolon where that counts, dealt to the rows of a table.
_NAMES = sorted(html5)
_NAME_ROWS = ", ".join(f"({i}, {sql_text(n)}, {sql_text(html5[n])})" for i, n in enumerate(_NAMES))


@query("ex1_references", sql=f"""
with n as (select * from (values {_NAME_ROWS}) t(i, name, shown))
select l_orderkey, l_linenumber, l_linestatus || ' ' || shown || l_partkey || ' &' || l_returnflag || 'zz; A' || l_linenumber || '&' as text
from (select *, (l_orderkey * 8 + l_linenumber) % {len(_NAMES)} as i from lineitem) join n using (i)""")
def ex1_references(spark, sf):
    rows = fx.table(spark, sf, "lineitem")
    names = F.array(*[F.lit(n) for n in _NAMES])
    name = F.get(names, ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) % len(_NAMES)).cast("int"))
    rows = rows.withColumn("__n", name)
    raw = F.concat(
        F.col("l_linestatus"), F.lit(" &"), F.col("__n"), F.col("l_partkey"), F.lit(" &"), F.col("l_returnflag"),
        F.lit("zz; &#x41;"), F.col("l_linenumber"), F.lit("&amp;"))
    rows = rows.select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", decode_references("raw").alias("text"))


@query("ex2_container_anchors", using="fx_pages", sql=f"""
with {ANCHORS}, boxes as (
  select page_id, len(regexp_extract_all(lower(html),
    '<(article|div)[^>]*class="[^"]*(job|position|career|opening)')) > 0 as scoped from fx_pages)
select page_id, pos, href, anchor_text from anchors join boxes using (page_id) where not scoped""")
def ex2(spark, sf):
    # no page of the test data has such a container, so each is searched as a whole
    links = dom_links(fx.pages(spark, sf), with_context=False)
    return scoped_links(links).filter("anchor_text != ''").select("page_id", "pos", "href", "anchor_text")


@query("ex2_scoped_anchors", using="fx_pages", sql=f"""
with {ANCHORS} select page_id, pos, href, anchor_text from anchors""")
def ex2b(spark, sf):
    # every page gets a container around its navigation and one without links
    html = F.replace(F.replace(F.col("html"), F.lit("<nav>"), F.lit('<div class="Open-Positions">')),
                     F.lit("</nav>"), F.lit('</div><div class="careers">none</div>'))
    html = F.replace(html, F.lit("<footer>"), F.lit('<footer><a href="/outside">outside</a>'))
    links = dom_links(fx.pages(spark, sf).withColumn("html", html), with_context=False)
    return scoped_links(links).select("page_id", "pos", "href", "anchor_text")


@query("ex3_parent_context", using="fx_pages", sql=r"""
with items as (
  select page_id, unnest(regexp_extract_all(html, '<li>.*?</li>')) as li from fx_pages)
select page_id, regexp_extract(li, 'href="([^"]*)"', 1) as href,
  regexp_replace(li, '<[^>]*>', '', 'g') as parent_text from items""")
def ex3(spark, sf):
    return dom_links(fx.pages(spark, sf)).select("page_id", "href", "parent_text")


@query("ex4_main_text", using="fx_pages", sql=r"""
with body as (
  select page_id, regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) as b from fx_pages),
flat as (
  select page_id, regexp_replace(b, '\s*(<[^>]*>\s*)+', ' ', 'g') as t from body),
plain as (
  select page_id, replace(replace(replace(replace(replace(replace(t,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') as t from flat)
select page_id, trim(t, e' \t\n\r') as main_text from plain""")
def ex4(spark, sf):
    return main_text(fx.pages(spark, sf)).select("page_id", "main_text")


_ITEM_RULE = (Pick(tag="li"),)


@query("ex5_rule_records", using="fx_pages", sql=r"""
with items as (
  select page_id, site, url, regexp_extract_all(html, '<li>.*?</li>') as lis from fx_pages),
rows as (select page_id, site, url, unnest(range(1, len(lis) + 1)) as i, lis from items)
select page_id, site, cast(i as int) as card_pos, regexp_replace(lis[i], '<[^>]*>', '', 'g') as card_text,
  regexp_extract(lis[i], 'href="([^"]*)"', 1) as href from rows""")
def ex5(spark, sf):
    # one rule for every landed site: cards are list items, titles their links
    pages = fx.pages(spark, sf)
    rule = RecordRule("any", _ITEM_RULE, (Pick(tag="a"),))
    cards = extract_records(pages.withColumn("site", F.lit("any")), {"any": rule})
    named = cards.drop("site").join(pages.select("page_id", "site"), "page_id")
    return named.select("page_id", "site", "card_pos", "card_text", "href")


SECTION = SectionPolicy(
    markers=("the", "que", "die"), roles=("The ", "La ", "Die "), divisions=("An", "En", "Er"),
    min_text=100, lines=15, division_max=80)


@query("ex6_section_title", sql=f"""
with lines as (
  select doc_id, unnest(range(1, least(15, len(string_split(text, chr(10)))) + 1)) as i,
    string_split(text, chr(10)) as ls from documents
  where {sql_any('text', SECTION.markers)} and length(text) >= 100),
kinds as (
  select doc_id, i, trim(ls[i], {SQL_BLANKS}) as line from lines),
marked as (
  select *, {sql_any('line', SECTION.roles)} as is_role,
    not {sql_any('line', SECTION.roles)} and {sql_any('line', SECTION.divisions)}
      and length(line) < 80 as is_div from kinds),
stops as (
  select doc_id, greatest(min(i) filter (is_role), min(i) filter (is_div)) as both_at,
    count(*) filter (is_role) as roles, count(*) filter (is_div) as divs from marked group by doc_id),
read as (
  select m.* from marked m join stops s using (doc_id)
  where roles > 0 and (divs = 0 or m.i <= both_at)),
parts as (
  select doc_id, arg_max(line, i) filter (is_role) as role, arg_max(line, i) filter (is_div) as division
  from read group by doc_id)
select doc_id, case when division is null then role else division || ' - ' || role end as section_title
from parts""")
def ex6(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return with_section_title(docs, SECTION).select("doc_id", "section_title")


@query("ex7_first_line_title", sql=r"""
with l as (select doc_id, text, trim(string_split(text, chr(10))[1], e' \t\n\r') as line from documents)
select doc_id, case when length(line) < 40 then trim(substring(text, 1, 80), e' \t\n\r') else line end as title
from l""")
def ex7(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", first_line_title(F.col("text"), 40).alias("title"))


@query("ex8_fallback_rows", using="fx_records", sql="""
with sites as (
  select distinct source as company, 'https://' || source || '.example.com/' as url from documents
  union all select distinct 'none-' || source, 'https://none.example.com/' || source from documents),
good as (select * from fx_records where lang = 'de')
select company, title, url, false as is_fallback from good
union all
select company, 'All positions', url, true from sites where company not in (select company from good)""")
def ex8(spark, sf):
    docs = fx.table(spark, sf, "documents").select("source").distinct()
    sites = docs.select(
        F.col("source").alias("company"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/")).alias("url"),
    ).unionByName(docs.select(
        F.concat(F.lit("none-"), "source").alias("company"),
        F.concat(F.lit("https://none.example.com/"), "source").alias("url")))
    german = fx.records(spark, sf).filter("lang = 'de'")
    rows = with_fallback_rows(sites, german, F.lit("All positions"), F.lit("See page."))
    return rows.select("company", "title", "url", "is_fallback")


@query("ex9_title_sources", sql="""
select event_id, coalesce(nullif(trim(case when event_type = 'view' then '  ' when event_type = 'click'
    then null else event_type end), ''),
  nullif(trim(case when user_id % 2 = 0 then ' ' else 'user ' || user_id end), ''), props, '') as title
from events""")
def ex9(spark, sf):
    events = fx.table(spark, sf, "events")
    text = F.when(F.col("event_type") == "view", "  ").when(F.col("event_type") == "click", None) \
        .otherwise(F.col("event_type"))
    label = F.when(F.col("user_id") % 2 == 0, " ").otherwise(F.concat(F.lit("user "), "user_id"))
    return events.select("event_id", first_nonblank(text, label, F.col("props")).alias("title"))


@query("ex9_titled_anchors", using="fx_pages", sql=f"""
with {ANCHORS} select page_id, pos, href, anchor_text as anchor_title from anchors""")
def ex9b(spark, sf):
    return titled_anchors(fx.pages(spark, sf)).select("page_id", "pos", "href", "anchor_title")


@query("ex9_labelled_anchors", using="fx_pages", sql=r"""
with items as (
  select page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) as href,
    unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) as word from fx_pages)
select page_id, href, 'label ' || word as anchor_title from items
union all select page_id, href || '?t', 'title ' || word from items
union all select page_id, href || '?x', word from items""")
def ex9c(spark, sf):
    # every listed link three times: with a label only, with a blank label and a title, with a text that wins over both
    forms = ('<li><a aria-label="label $2" title="title" href="$1"> &nbsp; </a></li>'
             '<li><a title="title $2" href="$1?t" aria-label=" "><b></b></a></li>'
             '<li><a href="$1?x" title="title" aria-label="label">$2</a></li>')
    html = F.regexp_replace("html", '<li><a href="([^"]*)">([^<]*)</a></li>', F.lit(forms))
    pages = fx.pages(spark, sf).withColumn("html", html)
    links = titled_anchors(pages).select("page_id", "href", "anchor_title")
    return links.where("href like '%?t' or href like '%?x' or anchor_title like 'label %'")


@query("ex10_bounded_text", sql=r"""
select doc_id, trim(substring(text, 1, 100), e' \t\n\r') as title,
  trim(substring(text, 1, 300), e' \t\n\r') as body, trim(substring(text, 1, 250), e' \t\n\r') as snippet
from documents""")
def ex10(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", bounded(text, 100).alias("title"), bounded(text, 300).alias("body"),
        bounded(text, 250).alias("snippet"))


# -------------------------------------------------------------------- urls

# Eight reference shapes per anchor, each with its expected form spelled out.
_SHAPES_SQL = f"""
  shapes as (
    select page_id, pos, page_url, {ORIGIN} as origin, substr(href, 2) as w,
      regexp_extract(page_url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as bpath,
      regexp_extract(page_url, '^[^?#]*\\?([^#]*)', 1) as bq
    from anchors),
  dirs as (select *, regexp_replace(bpath, '[^/]*$', '') as dir from shapes),
  ups as (select *, regexp_replace(dir, '[^/]*/$', '') as up from dirs)
"""


def _shapes(spark, sf):
    links = text_anchors(fx.pages(spark, sf).withColumnRenamed("url", "page_url"))
    word = F.expr("substring(href, 2)")
    forms = {
        "root": F.concat(F.lit("/"), word),
        "relative": F.concat(word, F.lit("?x=1#a")),
        "parent": F.concat(F.lit("../"), word, F.lit(";v=1")),
        "scheme": F.concat(F.lit("//cdn.example.com/"), word),
        "fragment": F.concat(F.lit("#"), word),
        "query": F.concat(F.lit("?q="), word),
        "script": F.concat(F.lit("javascript:"), word),
        "dots": F.concat(F.lit("./a/../"), word, F.lit("/")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("form"), v.alias("ref")) for k, v in forms.items()])
    return links.select("page_id", "pos", "page_url", F.inline_outer(pairs))


def _expected(clean: bool) -> str:
    tail = "" if clean else "#a"
    params = "" if clean else ";v=1"
    bq = "case when bq <> '' then '?' || bq else '' end"
    frag = "''" if clean else "'#' || w"
    script = "null" if clean else "'javascript:' || w"
    up = "case when up = '' then '/' else up end"
    return f"""
      select page_id, pos, 'root' as form, origin || '/' || w as url from ups
      union all select page_id, pos, 'relative', origin || dir || w || '?x=1{tail}' from ups
      union all select page_id, pos, 'parent', origin || {up} || w || '{params}' from ups
      union all select page_id, pos, 'scheme', 'https://cdn.example.com/' || w from ups
      union all select page_id, pos, 'fragment', origin || bpath || {bq} || {frag} from ups
      union all select page_id, pos, 'query', origin || bpath || '?q=' || w from ups
      union all select page_id, pos, 'script', {script} from ups
      union all select page_id, pos, 'dots', origin || dir || w || '/' from ups"""


@query("ur1_normalize_clean", using="fx_pages", sql=f"""
with {ANCHORS}, {_SHAPES_SQL}, expected as ({_expected(True)}) select * from expected""")
def ur1(spark, sf):
    return urls.with_clean_url(_shapes(spark, sf), "ref", "page_url", "url").select(
        "page_id", "pos", "form", "url")


@query("ur2_normalize_record", using="fx_pages", sql=f"""
with {ANCHORS}, {_SHAPES_SQL}, expected as ({_expected(False)}) select * from expected""")
def ur2(spark, sf):
    return urls.with_record_url(_shapes(spark, sf), "ref", "page_url", "url").select(
        "page_id", "pos", "form", "url")


@query("ur3_url_validity", using="fx_pages", sql=f"""
with {ANCHORS}, refs as (
  select page_url as u from anchors union all select href from anchors
  union all select 'mailto:' || anchor_text from anchors)
select u as url, regexp_matches(u, '^[a-z]+://[^/?#]+') as is_valid, count(*) as n from refs group by all""")
def ur3(spark, sf):
    links = text_anchors(fx.pages(spark, sf))
    refs = F.array(F.col("url"), F.col("href"), F.concat(F.lit("mailto:"), "anchor_text"))
    rows = links.select(F.explode_outer(refs).alias("url"))
    return rows.groupBy("url").agg(
        F.first(urls.is_absolute(F.col("url"))).alias("is_valid"), F.count("*").alias("n"))


@query("ur4_section_url", using="fx_records", sql="""
select doc_id, 'https://jobs.example.com/' || company || '#' || substring(md5(title), 1, 8) as url from fx_records""")
def ur4(spark, sf):
    page = F.concat(F.lit(fx.URL_ROOT), "company")
    return fx.records(spark, sf).select("doc_id", urls.section_url(page, F.col("title")).alias("url"))


@query("ur5_keys", using="fx_records", sql="""
select doc_id, sha256(url) as seen_key, md5(url) as snapshot_key, md5(company || '|' || url) as posting_id
from fx_records""")
def ur5(spark, sf):
    url = F.col("url")
    return fx.records(spark, sf).select(
        "doc_id", urls.seen_key(url).alias("seen_key"), urls.snapshot_key(url).alias("snapshot_key"),
        urls.posting_id(F.col("company"), url).alias("posting_id"))


@query("ex6_section_records", using="fx_records", sql=f"""
with lines as (
  select doc_id, company, text, unnest(range(1, least(15, len(string_split(text, chr(10)))) + 1)) as i,
    string_split(text, chr(10)) as ls from fx_records
  where {sql_any('text', SECTION.markers)} and length(text) >= 100),
kinds as (
  select doc_id, i, trim(ls[i], {SQL_BLANKS}) as line from lines),
marked as (
  select *, {sql_any('line', SECTION.roles)} as is_role,
    not {sql_any('line', SECTION.roles)} and {sql_any('line', SECTION.divisions)}
      and length(line) < 80 as is_div from kinds),
stops as (
  select doc_id, greatest(min(i) filter (is_role), min(i) filter (is_div)) as both_at,
    count(*) filter (is_role) as roles, count(*) filter (is_div) as divs from marked group by doc_id),
read as (
  select m.* from marked m join stops s using (doc_id)
  where roles > 0 and (divs = 0 or m.i <= both_at)),
parts as (
  select doc_id, arg_max(line, i) filter (is_role) as role, arg_max(line, i) filter (is_div) as division
  from read group by doc_id),
titled as (
  select p.doc_id, r.company, r.text,
    case when division is null then role else division || ' - ' || role end as full_title
  from parts p join fx_records r using (doc_id)),
ranked as (
  select *, row_number() over (partition by company, full_title order by doc_id) as rn from titled)
select company as page_id, doc_id, substring(full_title, 1, 100) as title,
  'https://jobs.example.com/' || company || '#' || substring(md5(full_title), 1, 8) as url,
  trim(replace(substring(text, 1, 500), chr(10), ' '), {SQL_BLANKS}) as text
from ranked where rn = 1""")
def ex6b(spark, sf):
    blocks = fx.records(spark, sf).select(
        F.col("company").alias("page_id"), "doc_id", "text",
        F.concat(F.lit(fx.URL_ROOT), "company").alias("url"))
    return section_records(blocks, SECTION, order="doc_id")
