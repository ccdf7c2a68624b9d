"""Extraction on hand-made pages: native and parser forms."""

import html as html_lib

from pyspark.sql import functions as F

from careerlens.functions.markup import NAMED_REFERENCES, decode_references
from careerlens.lexicon import CandidatePolicy, LinkPolicy, SectionPolicy
from careerlens.operators.anchors import extract_anchors, text_anchors, titled_anchors
from careerlens.operators.dom import dom_links, scoped_links
from careerlens.operators.main_text import main_text
from careerlens.operators.records import with_section_title
from careerlens.plans import keyword_scan, scored_scan, site_records

PAGE = """<html><body><nav><a href="/about">About us today</a></nav>
<div class="JobList"><div class="job-card"><p>2026 intake <a href="/jobs/1">Software <b>Engineer</b></a></p></div>
<a href="/jobs/1#apply">Software Engineer apply</a><a href="/jobs/2" aria-label="Data Scientist graduate"></a></div></body></html>"""


def _pages(spark, *sources, site="s", keywords=("2026",), url="https://ex.com/careers/list"):
    return spark.createDataFrame(
        [(i, site, site, url, url, list(keywords), s) for i, s in enumerate(sources)],
        "page_id bigint, site string, company string, url string, page_url string, keywords array<string>, html string")


def test_keyword_scan_uses_containers_and_context(spark):
    got = keyword_scan.context_matches(_pages(spark, PAGE)).collect()
    assert [(r.title, r.url, r.matched_keywords) for r in got] == [
        ("Software Engineer", "https://ex.com/jobs/1", ["2026"])]


def test_scored_scan_candidates(spark):
    got = scored_scan.link_candidates(_pages(spark, PAGE), CandidatePolicy())
    assert {(r.title, r.url) for r in got.collect()} == {
        ("SoftwareEngineer", "https://ex.com/jobs/1"), ("Data Scientist graduate", "https://ex.com/jobs/2")}


def test_container_without_links_hides_the_rest_of_the_page(spark):
    page = '<div class="careers">none</div><p><a href="/x">Some job link 2026</a></p>'
    assert scoped_links(dom_links(_pages(spark, page))).count() == 0
    assert scoped_links(dom_links(_pages(spark, page.replace("careers", "other")))).count() == 1


def test_keyword_across_link_and_context_start(spark):
    page = '<p>Graduate school <a href="/x">Brand New</a></p>'
    hit = keyword_scan.context_matches(_pages(spark, page, keywords=("new graduate",)),
                                       policy=LinkPolicy(min_text=3))
    # link text + blank + parent text reads "Brand New Graduate school Brand New"
    assert [r.matched_keywords for r in hit.collect()] == [["new graduate"]]


def test_context_against_plain_search_on_tangled_pages(spark):
    """Nested unclosed elements: every keyword in link text or parent text, by brute force."""
    import random

    from careerlens.operators.dom import context_links

    rng = random.Random(9)
    bits = ["<p>", "<div>", "</div>", "<li>", "</p>", "<b>", "</b>", "<script>alpha</script>", "alpha ", "BETA", "gam", "ma ",
            "<a href='/1'>alpha</a>", "<a href='/2'>x <i>be</i>ta</a>", "<a href='/3'>gam</a>", "<a href='/4'>open ", "é"]
    words = ["Alpha", "beta", "gamma", "a b", "x beta", "zz"]
    pages = _pages(spark, *["".join(rng.choices(bits, k=rng.randint(5, 40))) for _ in range(150)], keywords=words)
    wide = dom_links(pages).select("page_id", "pos", "anchor_text", "parent_text").collect()
    want = {(r.page_id, r.pos): [w for w in words if w.lower() in f"{r.anchor_text} {r.parent_text}".lower()] for r in wide}
    got = {(r.page_id, r.pos): r.matched_keywords for r in context_links(pages).collect()}
    assert len(got) > 300 and got == want


def test_deeply_nested_page_stays_proportional(spark):
    import time

    n = 20_000
    page = "".join(f"<p>text {i} <a href='/{i}'>Link number {i}</a>" for i in range(n))
    start = time.time()
    rows = keyword_scan.context_matches(_pages(spark, page, keywords=("text 19999", "nothing")))
    assert rows.count() == n
    assert time.time() - start < 60


def test_invisible_markup_is_ignored(spark):
    page = ("<!-- <a href='/no'>No comment</a> --><script>var x = '<a href=\"/no\">No script</a>'</script>"
            "<A HREF='/yes?a=1&amp;b=2' title='t'>  R&eacute;sum&#233; <i>&#x4E2D;</i> </A><a name='x'>no href</a>"
            "<a href=\"\">empty</a><a href=/bare>Bare</a>")
    native = [(r.href, r.anchor_text, r.anchor_title) for r in extract_anchors(_pages(spark, page)).orderBy("pos").collect()]
    assert native == [("/yes?a=1&b=2", "Résumé 中", "Résumé中"), ("/bare", "Bare", "Bare")]
    dom = [(r.href, r.anchor_text, r.anchor_title) for r in dom_links(_pages(spark, page)).orderBy("pos").collect()]
    assert dom == native


def test_label_attributes_stand_in_for_missing_text(spark):
    page = ('<a href="/1"> </a><a href="/2" aria-label=" L "></a><a href="/3" title="T" data-title="no"></a>'
            '<a href="/4" aria-label=" " title="T4"><img></a>')
    pages = _pages(spark, page)
    assert [r.anchor_title for r in titled_anchors(pages).orderBy("pos").collect()] == ["L", "T", "T4"]
    assert text_anchors(pages).count() == 0


def test_main_text_regions_and_nesting(spark):
    sources = [
        "<body>b<article>a</article><main> m <b>x</b>\n<script>no</script><!-- no --> y </main></body>",
        "<body>b<article>one<article>two</article>three</article>four</body>",
        "<body><p>only &lt;body&gt;</p></body>",
        "<p>no region</p>",
        "<body><article>never closed <p>end",
    ]
    got = {r.page_id: r.main_text for r in main_text(_pages(spark, *sources)).collect()}
    assert got == {0: "m x y", 1: "one two three", 2: "only <body>", 3: "", 4: "never closed end"}


def test_native_references_decode_like_the_standard_library(spark):
    texts = [f"x&{n};y" for n in NAMED_REFERENCES] + [
        "&amp;lt;", "&#65;&#x1F600;!", "&#x4e2d;&#25991;", "a & b", "&unknown;", "&#; &#x;", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [(r.t, r.d) for r in df.withColumn("d", decode_references("t")).collect()
             if r.t not in ("&#; &#x;",) and r.d != html_lib.unescape(r.t)]
    assert not wrong


def _section(title, lines, policy):
    """Line by line, as a reader would do it."""
    role = division = None
    for line in [x.strip() for x in lines[:policy.lines]]:
        if any(k in line for k in policy.roles):
            role = line
        elif any(k in line for k in policy.divisions) and len(line) < policy.division_max:
            division = line
        if role and division:
            break
    return None if role is None else f"{division} - {role}" if division else role


def test_section_title_against_line_by_line(spark):
    import random

    rng = random.Random(5)
    policy = SectionPolicy()
    pool = ["Software Engineer", " Data Scientist II ", "Alpha Inc.", "Cloud Division", "職種", "filler text " * 4,
            "Company " + "x" * 90, "", "AI Engineer at Company"]
    blocks = []
    for i in range(200):
        lines = [rng.choice(pool) for _ in range(rng.randint(3, 20))]
        blocks.append((i, "\n".join(lines) + "\n" + "pad " * 30))
    df = spark.createDataFrame(blocks, "i int, text string")
    got = {r.i: r.section_title for r in with_section_title(df, policy).collect()}
    for i, text in blocks:
        marked = any(m in text for m in policy.markers) and len(text) >= policy.min_text
        want = _section(None, text.split("\n"), policy) if marked else None
        assert got.get(i) == want, text


OPENINGS = """<div class="opening"><a href="/mercari/jobs/1">Backend Engineer</a> <span class="location">Tokyo</span></div>
<div class="opening"><a href="/mercari/jobs/2">Sales Lead</a></div>
<div class="opening"><a href="/mercari/jobs/1">Backend Engineer again</a></div>
<div class="closed"><a href="/mercari/jobs/3">Data Engineer</a></div>"""
SECTIONS = """<div class="job-box"><h3>Alpha Division</h3><p>Software Engineer, Search</p><p>{0}</p></div>
<div class="job-box"><h3>Alpha Division</h3><p>Software Engineer, Search</p><p>{0}</p></div>
<div class="jobs"><p>AI Engineer</p><p>{0}</p><a href="/entry/7">Apply</a></div>
<div class="job-box"><p>too short Software Engineer</p></div>""".format("職種 and what the team builds. " * 6)


def test_site_extractors(spark):
    mercari = _pages(spark, OPENINGS, site="mercari", url="https://boards.greenhouse.io/mercari")
    got = site_records.run_all(mercari, {"mercari": site_records.REGISTRY["mercari"]}).collect()
    assert [(r.company, r.title, r.url, r.text, r.location) for r in got] == [
        ("Mercari", "Backend Engineer", "https://boards.greenhouse.io/mercari/jobs/1", "Backend Engineer - Tokyo", "Tokyo")]

    page = "https://corp.example.jp/recruit/"
    rows = site_records.finish(site_records.section_site(_pages(spark, SECTIONS, site="rakuten", url=page))).collect()
    titles = {r.title: r.url for r in rows}
    assert set(titles) == {"Alpha Division - Software Engineer, Search", "AI Engineer"}
    assert titles["AI Engineer"] == "https://corp.example.jp/entry/7"
    assert titles["Alpha Division - Software Engineer, Search"].startswith(page + "#")

    empty = site_records.section_site(_pages(spark, "<p>closed</p>", site="rakuten", url=page)).collect()
    assert [(r.title, r.url) for r in empty] == [(site_records.SECTION_DEFAULT_TITLE, page)]


def test_other_site_extractors(spark):
    cases = {
        "line": ('<div class="course-item"><h3>Server side course</h3><a href="/c/1">more</a></div>'
                 '<div class="course-item">FAQ page here<a href="/faq">x</a></div><div class="course-item">no link</div>',
                 [("Server side course", "https://x.jp/c/1")]),
        "sony": ('<ul><li class="css-1"><h3><a href="/j/1"> Robotics Intern </a></h3><p>Tokyo</p></li>'
                 '<li class="css-2">no title</li></ul>', [("Robotics Intern", "https://x.jp/j/1")]),
        "bytedance": ('<div class="jobCard-x"><a class="jobTitle-1" href="https://b.com/1">Research Scientist</a></div>'
                      '<div class="jobCard-x"><a class="jobTitle-1" href="/rel">Engineer relative</a></div>'
                      '<div class="jobCard-x"><a class="jobTitle-1" href="https://b.com/2">Sales</a></div>',
                      [("Research Scientist", "https://b.com/1")]),
        "toshiba": ('<a href="/pages/toshiba/jobs/9"><p>Power electronics designer</p><p>Fuchu</p></a>'
                    '<a href="/pages/toshiba/jobs/8">short</a>'
                    '<a href="/pages/toshiba/jobs/7">12 件の検索結果 and some more text</a>',
                    [("Power electronics designer", "https://x.jp/pages/toshiba/jobs/9")]),
        "preferred": ('<a href="/careers/1">Research Engineer position</a><a href="/careers/faq">FAQ for the engineer</a>'
                      '<a href="/careers/2">Life here is good</a>', [("Research Engineer position", "https://x.jp/careers/1")]),
    }
    for key, (page, want) in cases.items():
        pages = _pages(spark, page, site=key, url="https://x.jp/start")
        rows = site_records.run_all(pages, {key: site_records.REGISTRY[key]}).collect()
        assert [(r.title, r.url) for r in rows] == want, key


def test_registered_plug_in_goes_through_the_finishing_step(spark):
    def mine(pages):
        return pages.select(
            F.lit(" Mine ").alias("company"), F.lit("  A title ").alias("title"), F.lit("https://m.x/1").alias("url"),
            F.lit("t").alias("text"), F.lit("").alias("location"), F.struct("page_id").alias("ord"))

    site_records.register("mine", mine)
    try:
        rows = site_records.run_all(_pages(spark, "a", "b"), {"mine": site_records.REGISTRY["mine"]}).collect()
    finally:
        del site_records.REGISTRY["mine"]
    assert [(r.company, r.title, r.site) for r in rows] == [("Mine", "A title", "mine")]


def test_workers_need_no_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from careerlens.operators.dom import parse_page
    from careerlens.streaming.refetch import _Gate

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((parse_page, site_records.RULES["line"], _Gate(1))))
    code = ("import pickle; f, rule, gate = pickle.load(open('f.pkl', 'rb')); "
            "print(f('<p>x <b>y</b></p>').text(), rule.card[0].accepts(f('<p class=course-item>').find('p')))")
    done = subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == ["x", "y", "True"], done.stderr


def test_random_references_equal_the_standard_library(spark):
    """Numbers, all names with and without a semicolon, prefixes of names and text that only looks like them."""
    import random

    from careerlens.functions.markup import OPEN_REFERENCES

    rng = random.Random(5)
    bodies = ["#0", "#9999999", "#xD800", "#128", "#129", "#159", "#x00000041", "#38", "#x26", "#65x", "#1", "#11", "#xFFFE",
              "#x10FFFF", "#x110000", "#" + "9" * 40, "#x" + "f" * 40, "#xZ", "#", "amp", "lt", "oacute", "aacute", "nbsp",
              "nosuchname", "", "#13", "#x1FFFF", "#160", "notit", "ampx", "NotEqualTilde", "lsqb", "copy 2020", "nbsp x", "ngt",
              "CounterClockwiseContourIntegral", "CounterClockwiseContourIntegrals", "a" * 40, "amp" + "b" * 40, "not" + "in" * 20]
    every = [*NAMED_REFERENCES, *OPEN_REFERENCES]
    part = lambda: rng.choice(["a", "&", ";", "&" + rng.choice(bodies) + ";", "&" + rng.choice(bodies), "&#" + str(rng.randrange(1 << 22)) + ";",
                               "lt;", "&" + rng.choice(every) + rng.choice([";", "", "x", " ", "1;", "=", ".b;"])])
    texts = ["".join(part() for _ in range(rng.randrange(1, 8))) for _ in range(6000)]
    texts += [f"&{n}{tail}" for n in every for tail in (";", "", "x;")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [(r.t, r.d, html_lib.unescape(r.t)) for r in df.withColumn("d", decode_references("t")).collect() if r.d != html_lib.unescape(r.t)]
    assert not wrong


def test_nested_links_give_linear_output(spark):
    """20,000 links that are never closed nest into each other: the parser's output is the page, not its square."""
    from careerlens.operators.dom import context_links, page_links

    html = "<body>" + "".join(f"<a href='/{i}'>t{i} " for i in range(20_000))
    pages = _pages(spark, html, keywords=["t19999", "t7 ", "absent"])
    row = page_links(pages).first()
    assert len(row.links) == 20_000 and len(row.page_text) + len(row.page_tight) < 2 * len(html)
    some = dom_links(pages).filter("pos in (1, 19999, 20000)").orderBy("pos").collect()
    assert [r.anchor_text for r in some][1:] == ["t19998 t19999", "t19999"] and some[0].anchor_text.startswith("t0 t1 ")
    assert some[2].parent_text == "t19998 t19999 " and some[2].anchor_title == "t19999"
    found = context_links(pages).filter("pos in (1, 9, 10, 20000)").select("pos", "matched_keywords").orderBy("pos").collect()
    assert [r.matched_keywords for r in found] == [["t19999", "t7 "], ["t19999", "t7 "], ["t19999"], ["t19999"]]


def test_links_in_hidden_elements_have_their_own_text(spark):
    pages = _pages(spark, "<div>a<template><p>b<a href='/x'>c <i> d</i></a></p></template><a href='/y' aria-label='e'> </a></div>")
    got = [(r.href, r.anchor_text, r.anchor_title, r.parent_text) for r in dom_links(pages).orderBy("pos").collect()]
    assert got == [("/x", "c  d", "cd", "bc  d"), ("/y", "", "e", "a ")]


def test_nested_cards_give_linear_output(spark):
    from careerlens.operators.dom import Pick, RecordRule, extract_records

    html = "".join(f"<div class='c'><a href='/{i}'>t{i}</a>" for i in range(5_000))
    rows = extract_records(_pages(spark, html), {"s": RecordRule("s", (Pick(classes=("c",)),), (Pick(tag="a"),))})
    got = rows.select("card_pos", "title_text", "href", "card_text").filter("card_pos in (1, 4999, 5000)").orderBy("card_pos").collect()
    assert [(r.title_text, r.href) for r in got] == [("t0", "/0"), ("t4998", "/4998"), ("t4999", "/4999")]
    assert got[1].card_text == "t4998\nt4999" and got[0].card_text.startswith("t0\nt1\n")


def test_built_in_extractors_share_one_parser_stage(spark, sf):
    from careerlens.catalog import QUERIES

    text = QUERIES["ux1_built_in_extractors"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in text and "pages.parquet" not in text  # the cards are written, once


def test_references_are_decoded_outside_the_jvm_and_only_where_there_are_some(spark):
    df = spark.createDataFrame([("a &notit; &copyx",), ("plain",), (None,)], "t string").withColumn("d", decode_references("t"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and "Contains(t" in text and "CounterClockwise" not in text
    assert [r.d for r in df.collect()] == ["a ¬it; ©x", "plain", None]


def test_page_text_is_laid_out_for_rules_that_ask_for_texts_only(monkeypatch):
    from careerlens.operators import dom
    from careerlens.plans.site_records import RULES

    forms, layout = [], dom._layout
    monkeypatch.setattr(dom, "_layout", lambda root, *f, **k: forms.append(len(f)) or layout(root, *f, **k))
    root = dom.parse_page('<div class="job-1">x<a href="/1">エントリー</a></div>')
    assert dom._page_cards(root, RULES["mercari"])[1] == [] and len(dom._page_cards(root, RULES["rakuten"])[1]) == 1
    assert forms == [1, 2]
