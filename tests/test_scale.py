"""Plans and exact forms that must hold on skewed and large inputs."""

from pyspark.sql import functions as F

from careerlens.operators import dedup, profile_match as pm
from careerlens.operators.small_tables import literal_table, skew_safe_lookup
from careerlens.sources import standins as fx
from careerlens.sources.tables import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("url"), "id")
    text = plan(dedup.dedup_by_url(df, ["id"]))
    assert text.index("Partial") > text.index("Exchange") and text.count("WindowGroupLimit") == 2


def test_top_per_key_above_the_group_limit_is_exact(spark, rows):
    # one key holds most rows
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("k"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = dedup.top_per_key(df, ["k"], ["v"], 3000)
    want = {}
    for k, v in sorted(tuple(r) for r in df.collect()):
        want.setdefault(k, []).append(v)
    assert rows(got, "k", "v") == sorted(((k, v) for k, vs in want.items() for v in vs[:3000]), key=repr)


def test_cap_before_seen_filter(spark, rows):
    links = spark.createDataFrame([("s", i, u) for i, u in enumerate("xyz")], "company string, pos int, url string")
    capped = dedup.cap_per_key(links.withColumn("cap", F.lit(2)), ["company"], ["pos"], "cap", 30)
    seen = spark.createDataFrame([("x",)], "url string").select(F.sha2("url", 256).alias("seen_key"))
    assert rows(dedup.drop_seen(capped, seen), "url") == [("y",)]


def test_skew_safe_lookup_equals_plain_join(spark, rows):
    facts = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("key"))
    dim = facts.groupBy("key").agg(F.count("*").alias("w")).withColumn("value", F.length("key") * 1.5).filter("key <> 'k7'")
    got = skew_safe_lookup(facts, dim, "key", "w", "value", hot=50)
    assert rows(got) == rows(facts.join(dim.select("key", "value"), "key").select("id", "key", "value"))


def test_no_cartesian_products(spark, sf):
    from careerlens.catalog import QUERIES

    for name in ("jn4_keyword_pairs", "tl2_rank_projects", "jn8_profile_similarity", "sc9_score", "tl1_top_terms",
                 "src8_calendar", "scored_scan_matches"):
        text = plan(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scans_read_only_needed_columns(spark, sf):
    from careerlens.catalog import QUERIES

    text = plan(QUERIES["ag1_kpis"](spark, sf))
    assert "o_totalprice" not in text and "c_name" not in text
    text = plan(QUERIES["src6_seen_keys"](spark, sf))
    assert "lang" not in text and "source" not in text
    text = plan(QUERIES["pr12_multi_select"](spark, sf))
    assert "In(c_mktsegment" in text


def test_text_is_tokenised_once_per_pass(spark, sf):
    text = plan(pm.term_frequencies(fx.records(spark, sf), "doc_id"))
    assert text.count("split(") == 1


def test_spread_leaves_enough_splits_alone(spark, tmp_path):
    one = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(one)
    assert spread(spark.read.parquet(one), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = str(tmp_path / "many")
    spark.range(1000).repartition(40).write.parquet(many)
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")
    try:
        df = spark.read.parquet(many)
        assert spread(df, "id") is df
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_literal_tables_take_any_number_of_rows(spark):
    rows = literal_table(spark, [(i, ["a", None]) for i in range(10_001)], "i int, s array<string>")
    assert rows.count() == rows.filter("size(s) = 2 and s[1] is null").select("i").distinct().count() == 10_001


def test_reordered_skills_are_a_permutation(spark, sf):
    from careerlens.catalog.scoring import SKILLS

    rows = pm.reorder_skills(fx.records(spark, sf), SKILLS, "doc_id").collect()
    assert len(rows) == 3 * fx.records(spark, sf).count()
    assert all(sorted(r.skills) == sorted(SKILLS[r.category]) for r in rows)


def test_project_ranking_keeps_listed_order_on_ties(spark):
    df = spark.createDataFrame([(0, "nothing shared"), (1, "c c c")], "id int, text string")
    projects = [pm.Project(t) for t in "a b c d".split()]
    got = {}
    for r in pm.rank_projects(df, projects, "id").collect():
        got.setdefault(r.id, []).append((r.rank, r.project, r.shared_terms))
    assert sorted(got[0]) == [(1, "a", 0), (2, "b", 0), (3, "c", 0)]
    assert sorted(got[1]) == [(1, "c", 1), (2, "a", 0), (3, "b", 0)]


def test_frequent_terms_are_answered_without_a_shuffle(spark):
    facts = spark.range(100).select("id", (F.col("id") % 3).alias("key"))
    dim = facts.groupBy("key").agg(F.count("*").alias("w")).withColumn("value", F.lit(1.5))
    text = plan(skew_safe_lookup(facts, dim, "key", "w", "value", hot=50))
    assert "Union" in text and "__jk" not in text
