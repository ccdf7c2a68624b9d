"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest

from careerlens.llm import (edit_counts, exact_dedup, fingerprints, html_text, lm_score, mixing, near_dedup, packing,
                            toxicity, url_reputation)

LONG = "word and other words, " * 20_000
ROWS = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None),
        (3, "", "en", "b", 0), (None, "one two three four five six", "en", None, 3), (None, None, None, None, None),
        (4, LONG, "en", "a", 5), (5, LONG + "end", "de", "a", 5), (6, "one two three four five six", "fr", "b", 2), (7, " \n\t", "en", "b", 3)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def label_frame(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")


def mixed(docs):
    return mixing.mix(docs, mixing.tempered_weights(docs))


def mixed_rows(docs):
    return mixing.mixed_rows(docs, mixing.tempered_weights(docs))


OPERATORS = [lambda d: toxicity.toxicity(d, label_frame(d.sparkSession)), packing.pack_documents, fingerprints.fingerprints,
             near_dedup.near_classes, edit_counts.edit_counts, exact_dedup.exact_dedup, mixed, lm_score.lm_scores]
STAGES = [lambda d: toxicity.clean_rows(d, label_frame(d.sparkSession)), exact_dedup.drop_copies, near_dedup.drop_near, mixed_rows]
CLASHES = ("n_bytes", "content", "rank", "_bucket", "sig", "component", "component_id", "position", "row", "id", "s", "k",
           "block", "held_out", "score", "part", "guest", "length", "kept", "bands")


def with_clashes(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.mark.parametrize("at", range(len(OPERATORS)))
def test_operator(spark, at):
    docs = spark.createDataFrame(ROWS, KIND)
    rows = OPERATORS[at](docs).collect()
    ids = [r["doc_id"] for r in rows if r.asDict().get("piece", 0) == 0]
    assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)
    again = OPERATORS[at](with_clashes(docs)).collect()
    assert len(again) == len(rows)
    assert OPERATORS[at](docs.limit(0)).collect() == []


@pytest.mark.parametrize("at", range(len(STAGES)))
def test_stage(spark, at):
    docs = spark.createDataFrame(ROWS, KIND)
    out = STAGES[at](docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(ROWS)
    wide = with_clashes(docs)
    again = STAGES[at](wide)
    assert again.columns == wide.columns and again.count() == out.count()
    assert STAGES[at](docs.limit(0)).collect() == []


def test_exact_ties(spark):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark.createDataFrame(ROWS, KIND)).collect()}
    assert {(1, 6, 4, False), (6, 6, 4, True), (None, 6, 4, False), (2, 3, 3, False), (3, 3, 3, True), (7, 7, 1, True)} <= got
    stay = sorted(r["doc_id"] for r in exact_dedup.drop_copies(spark.createDataFrame(ROWS, KIND)).collect())
    assert stay == [3, 4, 5, 6, 7]


def test_near_ties(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_classes(spark.createDataFrame(ROWS, KIND)).collect()}
    assert {(1, 2, 1, True), (6, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True), (7, 0, 7, True), (None, 2, None, True), (None, 0, None, True)} <= got


def test_equal_texts_have_equal_fingerprints(spark):
    got = fingerprints.fingerprints(spark.createDataFrame(ROWS, KIND), parts=3).collect()
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 6)}) == 1 and len(got) == len(ROWS)
    lone = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c", "", "", 0)], KIND)).collect()
    assert [r["near_next"] for r in lone] == [1.0]


def test_pages(spark):
    kind = "page_id long, url string, html string, text string, host string, bad int"
    rows = [(1, None, None, "x", "x", 1), (None, "no scheme", "<p>a", "x", "x", 1), (2, "http://WWW.Example.NET:80/EN/x?y#z", "<p>b</p>", "", "", 0),
            (2, "https://a.example.net/en/1", "<p>" * 5000 + "deep", "", "", 0), (3, "ftp://org", "", "", "", 0), (4, "x://fr.org/fr/", "", "", "", 0)]
    pages = spark.createDataFrame(rows, kind)
    assert sorted(str(r["page_id"]) for r in html_text.extract(pages).collect()) == sorted(str(r[0]) for r in rows)
    outcomes = url_reputation.label_outcomes(label_frame(spark))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.url_verdicts(pages, outcomes).collect()}
    assert {(1, "", "", None), (None, "", "", None), (2, "www.example.net:80", "/EN/x", None), (2, "a.example.net", "/en/1", "example.net/en/"),
            (3, "org", "", None), (4, "fr.org", "/fr/", "org/fr/")} == {g[:4] for g in got}
    for f in (html_text.extract, lambda p: url_reputation.url_verdicts(p, outcomes)):
        assert f(pages.limit(0)).collect() == []


def test_reputation_blocks_bad_hosts(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.example.com/{i}") for i in range(400)] + [(1000, "http://new.example.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, bad int")
    got = {(r["host"], r["verdict"]) for r in url_reputation.url_verdicts(pages, outcomes).collect()}
    assert got == {("bad.example.com", "block"), ("good.example.com", "allow"), ("new.example.com", "allow")}


def test_one_key_with_most_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 > 0 then 'same text for all of these rows' else concat('text ', id) end as text",
                                        "case when id % 3 > 0 then 'hot' else concat('s', id % 7) end as source")
    assert mixed(docs).select("position").distinct().count() == 3000
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 1001
    assert near_dedup.near_classes(docs).agg({"n_shingles": "sum"}).first()[0] > 0


def test_whole_pipeline_on_an_empty_table_and_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    for name, docs in (("empty", []), ("odd", ROWS)):
        spark.createDataFrame(docs, KIND).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        label_frame(spark).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} <= {r[0] for r in docs} and bool(out) == bool(docs)
