"""Scoring: hand-checked table, a plain Python twin on random texts, clamps."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from careerlens.lexicon import Lexicon
from careerlens.operators import score as sc

LEX = Lexicon(
    required=("grad",), deal_breakers=("n1 required",), entry_level=("grad", "junior", "intern", "2026", "新卒"),
    penalties=(("senior", -.30), ("lead", -.35), ("director", -.45), ("phd preferred", -.10)),
    bachelor=("bachelor",), domain=("ai", "python", "backend", "llm", "english"))
GOLDEN = [
    ("Backend engineer", .90, 0.00), ("Grad role, N1 required", .90, 0.00), ("grad python", .40, 0.50),
    ("grad junior intern 2026 role", .40, 0.55), ("grad senior director", .80, 0.55),
    ("grad leading team", .50, 0.20), ("grad phd preferred", .50, 0.35), ("grad masters preferred", .50, 0.50),
    ("grad email bachelor", .50, 0.68), ("grad ai python backend llm english", .90, 1.00),
    ("grad director", .20, 0.00), ("grad 新卒", .30, 0.40),
]


def _vec(similarity):
    return [similarity, (1 - similarity ** 2) ** 0.5]


def _profile(spark):
    return spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")


def _input(spark, cases):
    return spark.createDataFrame(
        [(i, t, _vec(s)) for i, (t, s, *_) in enumerate(cases)], "i int, text string, embedding array<float>")


def test_golden_table(spark):
    out = sc.score(_input(spark, GOLDEN), _profile(spark), LEX).collect()
    for r in out:
        assert r.score == pytest.approx(GOLDEN[r.i][2], abs=1e-6), GOLDEN[r.i]


def test_required_stage_skipped_for_an_empty_list(spark):
    r = sc.score(_input(spark, [("python", .40)]), _profile(spark), replace(LEX, required=())).first()
    assert r.score == pytest.approx(0.45, abs=1e-6)


def test_strongest_penalty_is_optional(spark):
    r = sc.score(_input(spark, [("grad senior director", .80)]), _profile(spark),
                 replace(LEX, penalty_mode="strongest")).first()
    assert r.score == pytest.approx(0.40, abs=1e-6)


def _twin(text, sim, lex):
    low = text.lower()
    if lex.required and not any(k in low for k in lex.required):
        return 0.0
    if any(k.lower() in low for k in lex.deal_breakers):
        return 0.0
    total = sim
    total += min(.15, .05 * sum(k.lower() in low for k in lex.entry_level))
    total += next((w for k, w in lex.penalties if k.lower() in low), 0.0)
    if "phd preferred" in low or "doctoral preferred" in low:
        total -= .10
    elif "masters preferred" in low or "master's preferred" in low:
        total -= .05
    total += .08 * any(k in low for k in lex.bachelor)
    total += min(.20, .05 * sum(k.lower() in low for k in lex.domain))
    return max(0.0, min(1.0, total))


def test_default_lexicon_on_random_texts(spark):
    rng = random.Random(3)
    lex = Lexicon()
    words = [*lex.required, *lex.entry_level, *lex.domain, *lex.bachelor, *[k for k, _ in lex.penalties],
             "PhD preferred", "master's preferred", "doctoral preferred", "Tokyo", "team", "role", *lex.deal_breakers[:2]]
    cases = [(" ".join(rng.sample(words, rng.randint(1, 6))), round(rng.random(), 3)) for _ in range(300)]
    rows = sc.score(_input(spark, cases), _profile(spark), lex, explain=True).collect()
    assert {r.i for r in rows} == set(range(300))
    for r in rows:
        text, sim = cases[r.i]
        assert r.score == pytest.approx(_twin(text, sim, lex), abs=1e-6), text
        assert 0.0 <= r.score <= 1.0


def test_missing_vector_and_zero_norm_stay_unscored(spark):
    df = spark.createDataFrame(
        [(0, "grad", None), (1, "grad", [0.0, 0.0]), (2, "none", None)], "i int, text string, embedding array<float>")
    got = {r.i: r.score for r in sc.score(df, _profile(spark), LEX).collect()}
    assert got == {0: None, 1: None, 2: 0.0}


def test_site_record_policy(spark):
    df = spark.createDataFrame(
        [(0, "Data Engineer", "n1 required", _vec(.1)), (1, "FAQ", "x", _vec(.24)), (2, "Program", "x", _vec(.25001))],
        "i int, title string, text string, embedding array<float>")
    got = {r.i: round(r.score, 2) for r in sc.score_site_records(df, _profile(spark), LEX).collect()}
    assert got == {0: 0.50, 2: 0.25}


def test_encoder_sees_survivors_only(spark):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(s: pd.Series) -> pd.Series:
        assert not s.dropna().str.contains("reject").any()
        return s.map(lambda t: None if t is None else [float(len(t)), 1.0])

    df = spark.createDataFrame([(0, "grad a"), (1, "reject"), (2, "grad n1 required reject")], "i int, text string")
    got = {r.i: r.embedding for r in sc.encode_survivors(df, encode, LEX).collect()}
    assert got[0] == [6.0, 1.0] and got[1] is None and got[2] is None
    both = sc.score(sc.encode_survivors(df, encode, LEX), _profile(spark), LEX)
    assert both.filter("score > 0").count() == 1
