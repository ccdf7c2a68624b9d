"""Keyword tables against the theta join."""

import random

from pyspark.sql import functions as F

from careerlens.operators.keywords import keyword_hits, matched_keywords


def test_many_keywords_equal_the_theta_join(spark):
    rng = random.Random(1)
    letters = "abcdeé"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    words = sorted({word(rng.randrange(3, 9)) for _ in range(130_000)})[:100_000] + ["A b", "", None, "ABC", "abc"]
    texts = [(i, word(rng.randrange(0, 400)) + " a B " + word(50).upper()) for i in range(60)] + [(98, None), (99, "")]
    frame = spark.createDataFrame(texts, "k int, text string")
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    want = sorted({(i, w.lower()) for i, t in texts if t for w in words if w and w.lower() in t.lower()})
    whole = keyword_hits(frame, table, "k")
    assert sorted(map(tuple, whole.collect())) == want and len(want) > 5000
    text = whole._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Exchange" not in text
    parted = keyword_hits(frame, table, "k", part_bytes=2 << 20)
    assert sorted(map(tuple, parted.collect())) == want
    assert keyword_hits(frame, table.limit(0), "k").count() == 0


def test_matched_keywords_in_table_order(spark):
    frame = spark.createDataFrame([(1, "one TWO three", "x"), (1, "one TWO three", "x"), (2, "none", "x")], "k int, text string, word string")
    table = spark.createDataFrame([(3, "One"), (1, "three"), (2, "two"), (4, "four")], "ord int, keyword string")
    got = [tuple(r) for r in matched_keywords(frame, table, "k").collect()]
    assert sorted(got) == [(1, ["three", "two", "One"]), (2, ["One"])]  # "none" contains "one"


def test_configured_hosts_and_names_are_counted(spark, tmp_path):
    """Pages on a configured host, or naming a company of the calendar, count for their entries."""
    from careerlens.catalog import QUERIES

    pages = [(1, "https://boards.greenhouse.io/mercari/1", "<p>Join MERCARI or Sony group</p>"),
             (2, "https://hrmos.co/x", "<a href='/'>Mercari</a>"), (3, "https://other.example.com/", "<p>none</p>"),
             (4, "https://linecorp.com/en", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sites = {r.site_key: r.pages for r in QUERIES["src2_site_registry"](spark, str(tmp_path)).collect()}
    assert (sites["mercari"], sites["woven"], sites["toshiba"], sites["line"], sites["other.example.com"]) == (1, 1, 1, 0, 1)
    named = {r.company: r.pages for r in QUERIES["src8_calendar"](spark, str(tmp_path)).collect()}
    assert (named["Mercari"], named["Sony Group"], named["Rakuten"]) == (2, 1, 0)
    targets = {r.company: r.pages for r in QUERIES["src9_all_sources"](spark, str(tmp_path)).collect()}
    assert (targets["LINE Corporation"], targets["Daijob"]) == (1, 0)
