"""Every query of the subpackage against SQL or a plain Python form over its whole small table."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from careerlens.llm import (edit_counts, exact_dedup, fingerprints, html_text, lm_score, mixing, near_dedup, packing,
                            shingles, tokens, toxicity, url_reputation)
from careerlens.llm.catalog import ORACLES, QUERIES
from careerlens.llm.common import read, worker_cache, written


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    bag = lambda f: collections.Counter(map(repr, f[sorted(f)].astype(object).where(f.notna(), None).values.tolist()))
    assert sorted(got) == sorted(want) and bag(got) == bag(want)


def test_toxicity(spark, sf, docs):
    got = QUERIES["op1_toxicity"](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]
    assert (got["held_out"] == held).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_risk_and_gradient():
    """The non-negative risk by its definition, and its gradient by differences."""
    rng = np.random.default_rng(1)
    p, u, w, prior = rng.random((7, 4)).round(), rng.random((11, 4)).round(), rng.normal(size=5), 0.2
    loss = lambda x, sign: np.mean([1 / (1 + np.exp(sign * (sum(a * b for a, b in zip(r, w)) + w[-1]))) for r in x])
    toxic, clean, up, down = toxicity.risk(w, p, u, prior)
    assert (toxic, clean) == pytest.approx((prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)))
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        more, less = toxicity.risk(w + step, p, u, prior), toxicity.risk(w - step, p, u, prior)
        assert [up[i], down[i]] == pytest.approx([(more[k] - less[k]) / 2e-6 for k in (0, 1)], abs=1e-6)


def test_sampling_has_no_least_share(spark):
    """A share far below 1e-6 is drawn as such; a sample that comes out empty is an error and no classifier of nothing."""
    share = 9000 / 1e11
    assert toxicity.hash_limit(share) == pytest.approx(-2**63 + share * 2**64, abs=2**12)
    assert [toxicity.hash_limit(s) for s in (0, 0.5, 1)] == [-2**63, 0, 2**63 - 1]
    got = spark.range(2_000_000).withColumnRenamed("id", "doc_id").where(toxicity.of_hash(1e-4)).count()
    assert 120 < got < 290
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i < 20)) for i in range(200)], "doc_id long, toxic int")
    assert {r["positive"]: r["count"] for r in toxicity.sample_of(texts, known, 20, 200).groupBy("positive").count().collect()} == {True: 20, False: 200}
    with pytest.raises(ValueError):
        toxicity.sample_of(texts, known, 20, 10**11)


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "tempor"]
    rows = []
    for i in range(900):
        words = list(rng.choice(plain, 30))
        if i % 5 == 0:
            words[3:5] = rng.choice(["gruff", "snarl", "hiss"], 2)
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, labels).where("held_out").toPandas()
    truth = got["doc_id"] % 5 == 0
    assert ((got["predicted"] == 1) == truth).mean() > 0.98


def brute_pieces(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at, first = 0, (len(ids) - 1) % 2048 + 1
        for piece, stop in enumerate(range(first, len(ids) + 1, 2048)):
            part = np.array(ids[at:stop], "<u4").tobytes()
            yield doc_id, piece, at, stop - at, zlib.crc32(part)
            at = stop


def check_packing(got):
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *np.cumsum(rows["length"])[:-1]] and rows["length"].sum() <= 2048


def test_packing(spark, sf, docs):
    got = QUERIES["op2_packing"](spark, sf).toPandas()
    want = set(brute_pieces(zip(docs["doc_id"], docs["text"])))
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert len(got) == len(want)
    check_packing(got)
    assert got["sequence_id"].nunique() <= 1.02 * -(-got["length"].sum() // 2048) + 1


def best_fit_decreasing(counts, limit):
    gaps = []
    for length in range(limit, 0, -1):
        for _ in range(counts[length]):
            fits = [i for i, g in enumerate(gaps) if g >= length]
            if fits:
                gaps[min(fits, key=lambda i: gaps[i])] -= length
            else:
                gaps.append(limit - length)
    return len(gaps)


def test_pack_counts_uses_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = np.bincount(rng.integers(1, 65, 300), minlength=65)
        runs = packing.pack_counts(counts, 64)
        used = np.zeros(65, int)
        for pattern, times in runs:
            assert sum(pattern) <= 64
            np.add.at(used, list(pattern), times)
        assert (used == counts).all()
        assert sum(t for _, t in runs) <= best_fit_decreasing(counts, 64) + 1


def test_fingerprints(spark, sf, docs):
    got = QUERIES["op4_fingerprints"](spark, sf).toPandas().set_index("doc_id")
    order = docs.sort_values("doc_id", ascending=False)
    after = dict(zip(order["doc_id"], np.roll(order["text"].to_numpy(), -1)))
    a, b = shingles.permutations(fingerprints.PERMUTATIONS, 4)
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[doc_id][:cut]
        row = got.loc[doc_id]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(text)
        sig = [fingerprints.signature_of(t, a, b) for t in (text, edited, after[doc_id])]
        assert row["fingerprint"] == "".join(f"{x:08x}" for x in sig[0])
        assert row["edited_fingerprint"] == "".join(f"{x:08x}" for x in sig[1])
        assert row["near_edited"] == (sig[0] == sig[1]).mean() and row["near_next"] == (sig[0] == sig[2]).mean()
    assert len(got) == len(docs)


def brute_components(texts, part=85, whole=100):
    sets = {}
    for doc_id, text in texts:
        words = text.encode().lower().split()
        sets[doc_id] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    index = collections.defaultdict(list)
    for d in ids:
        for s in sets[d]:
            index[s].append(d)
    pairs = collections.Counter((m[i], m[j]) for m in index.values() for i in range(len(m)) for j in range(i))
    for (x, y), both in pairs.items():
        if whole * both >= part * (len(sets[x]) + len(sets[y]) - both):
            x, y = find(x), find(y)
            top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_dedup(spark, sf, docs):
    got = QUERIES["op5_near_dedup"](spark, sf).toPandas()
    want = brute_components(zip(docs["doc_id"], docs["text"]))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all() and len(got) == len(docs)


def test_near_dedup_hub_in_large_bucket(spark):
    """Copies that are only linked through the text they were made from, more than a small bucket holds."""
    base = [f"w{i}" for i in range(150)]
    rows = [(100, " ".join(base))]
    for k in range(60):
        words = list(base)
        words[(7 * k) % 140] = f"x{k}"
        words[(11 * k + 40) % 140] = f"y{k}"
        rows.append((k, " ".join(words)))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute_components(rows)


def test_near_dedup_exhaustive_round(spark):
    """Links between classes of a large bucket that no pivot reaches, over several blocks and rows of one id."""
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(12):
        own = [f"g{group}_{i}" for i in range(60)]
        for k in range(3):
            words = common + own
            for at in rng.choice(360, 2, replace=False):
                words[at] = f"x{group}_{k}_{at}"
            rows.append((group + 12 * k, " ".join(words)))
    rows.append((5, "another text of the same id as one above"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = near_dedup.sketch_table(docs)
    reps = near_dedup.representatives(marks)
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keyed.join(sizes, "key").withColumn("component", F.col("rep"))
    sets = near_dedup.shingle_sets(docs)
    got = [{tuple(r) for r in near_dedup.cross_links(shared, reps, sets, (85, 100), block=b).collect()} for b in (4, 64)]
    whole = {}
    for doc_id, text in rows:
        words = text.split()
        whole.setdefault(doc_id, []).append({tuple(words[i:i + 5]) for i in range(len(words) - 4)})
    want = {(a, b) for a in whole for b in whole if a > b
            if any(100 * len(s & t) >= 85 * len(s | t) for s in whole[a] for t in whole[b])}
    assert got[0] == got[1] == want and len(want) > 12
    small = near_dedup.near_classes(docs, small_bucket=1, pivots=1, block=4).select("doc_id", "component_id").collect()
    usual = near_dedup.near_classes(docs).select("doc_id", "component_id").collect()
    assert sorted(small) == sorted(usual)


def test_similar_pairs(spark, sf, docs):
    frame = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "A b c d e f g h i j"), (3, "a b c d e f g h i j k"),
                                   (4, "z y x")], "doc_id long, text string")
    got = {tuple(r) for r in fingerprints.similar_pairs(frame).collect()}
    assert got == {(3, 1)}


def test_prune_keeps_what_the_threshold_allows():
    least = near_dedup.least_agreements(0.85, 1e-5, 128, 16)
    rng = np.random.default_rng(1)
    same = rng.random((20000, 128)) < 0.85
    left = np.zeros((20000, 128), np.uint32)
    assert near_dedup.survive(left, np.where(same, 0, 1).astype(np.uint32), least).mean() > 0.9995
    far = rng.random((20000, 128)) < 0.5
    assert near_dedup.survive(left, np.where(far, 0, 1).astype(np.uint32), least).mean() < 0.001


def regex_text(html):
    """The article of a generated page by patterns alone: nothing in it is boilerplate."""
    import html as entities
    import re

    inner = re.search("(?s)<article>(.*)</article>", html)[1]
    blocks = re.split("(?i)</?(?:p|h1|ul|li|div)[^>]*>", inner.replace("<br>", " "))
    texts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_html_rows(spark, sf):
    got = QUERIES["op6_html_text"](spark, sf).toPandas().set_index("page_id")
    pages = read(spark, sf, "pages").toPandas()
    assert len(got) == len(pages)
    for page_id, url, html in zip(pages["page_id"], pages["url"], pages["html"]):
        want = regex_text(html)
        assert got.loc[page_id].tolist() == [url, want, len(want)]


def test_html_rows_without_article(spark, sf):
    """The same pages with plain containers in the place of articles: ratios find the same content."""
    pages = read(spark, sf, "pages")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", "<div class='body'>"), "</article>", "</div>"))
    box = "<div class='x1'><ul><li><a href=/a>One</a><li><a href=/b>Two</a><li><a href=/c>More</a><li><a href=/d>Four</a></ul></div>"
    boxed = bare.withColumn("html", F.regexp_replace("html", "<footer>", box + "<footer>"))
    for frame in (bare, boxed):
        got = html_text.extract(frame).toPandas().set_index("page_id")["text"]
        for page_id, html in pages.select("page_id", "html").collect():
            want = regex_text(html)  # beside a few words no box stands out
            assert got[page_id] == want or frame is boxed and len(want) < 400 and got[page_id].startswith(want)


def test_smoothing_by_hand():
    ratios = np.array([1.0, 50.0, 3.0, 0.5, 0.0, 9.0])
    weight = [np.exp(-d * d / 2) for d in range(3)]
    want = []
    for i in range(6):
        near = [j for j in range(6) if abs(i - j) <= 2]
        want.append(sum(weight[abs(i - j)] * ratios[j] for j in near) / sum(weight[abs(i - j)] for j in near))
    assert html_text.smoothed(ratios) == pytest.approx(want)


def test_kept_lines():
    """Containers above the deviation, the best one in any case, and what lies between kept ones of a parent."""
    ratios, parents = np.array([90.0, 80.0, 1.0, 70.0, 1.0, 1.0]), np.array([0, 0, 0, 0, 0])
    assert html_text.kept_lines(ratios, np.array([1, 1, 2, 3, 4, 4]), parents).tolist() == [True] * 4 + [False] * 2
    assert html_text.kept_lines(np.array([1.0, 1.0]), np.array([0, 1]), np.array([0, 0])).tolist() == [True, True]


@pytest.mark.parametrize("html", ["<b>" * 40_000 + "x" + "</i>" * 210_000, "<td><ul>" + "<b>" * 60_000 + "<td></td>" * 90_000,
                                  "<p><b>" * 160_000, "</div>" * 170_000, "<li><i>" * 140_000, "<div><p>" * 120_000])
def test_html_unmatched_tags(html):
    import time

    assert len(html) > 700_000
    start = time.perf_counter()
    html_text.main_text(html)
    per_mb = (time.perf_counter() - start) / len(html) * 1e6
    assert per_mb < 6  # proportional to the length; the quadratic form took minutes


@pytest.mark.parametrize("html, text", [
    ("", ""), (None, ""), ("<nav>Menu</nav><div class='ad'>Buy</div><article><h1>Title</h1><p>One &amp; two<br>three</article><footer>x</footer>",
                           "Title\nOne & two three"),
    ("<body><div id=sidebar>Links</div><p>Some longer text in the only paragraph.<p>And  another\none.</body>",
     "Some longer text in the only paragraph.\nAnd another one."),
    ("<article><header><h1>T</h1></header><p>Body text<ul><li>a<li>b</ul><div class='comments'><p>me too</div></article>", "T\nBody text\na\nb"),
    ("<script>var a='</p>';</script><style>p{}</style><form><p>Name</p></form>plain", "plain"),
    ("<article><p>A&#9999999;B &#x80; &oacute;</p></article>", "A\ufffdB \u20ac \u00f3"),
    ("<article><p><b>open <i>never closed<p>next</article><p>outside", "open never closed\nnext"),
    ("<main><p>Text</p><article class='comment'><p>me too</p></article></main><article class='related-post'>more</article>", "Text"),
    ("<article><p>a</p><div class='share-price'>5.20</div><ul class='search-results'><li>b</li></ul><p class='adverb'>c</p></article>", "a\n5.20\nb\nc"),
    ("<article><p>a</p><div class='ad-1'>x</div><div class='commentList'>y</div><div id='cookie-notice'>z</div><p>b</p></article>", "a\nb"),
    ("<article><p class='ad'>x" + "<i>" * 9 + "<div>content</div></article>", "content"),
    ("<article><div class='header'>Title</div><p>a</article>", "Title\na"),
])
def test_html_cases(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("before, after", [(8, 0), (5, 5), (6, 6), (10, 8), (4, 6)])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_list_after_advert(tag, before, after):
    """Short blocks between adverts stay, however long the paragraphs around them are."""
    long = [f"<p>{'word ' * 59}{i:05}</p>" for i in range(before + after)]
    items = "<ul>" + "".join(f"<li>item {i:07}</li>" for i in range(4)) + "</ul>"
    advert = "<div class='advert'>Buy this</div>"
    html = f"<body><p>outside</p><{tag}>{''.join(long[:before])}{advert}{items}{advert}{''.join(long[before:])}</{tag}></body>"
    paragraphs = [f"{'word ' * 59}{i:05}" for i in range(before + after)]
    want = paragraphs[:before] + [f"item {i:07}" for i in range(4)] + paragraphs[before:]
    assert html_text.main_text(html) == "\n".join(want)


def test_edit_counts(spark, sf, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    got = QUERIES["op7_edit_counts"](spark, sf).toPandas().set_index("doc_id")
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        new = text
        for start, stop, ins in edit_counts.sample_edits(text):
            new = new[:start] + ins + new[stop:]
        row = got.loc[doc_id]
        assert (row["n_tokens"], row["edited_tokens"]) == (count(text), count(new))
        assert row["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
    assert len(got) == len(docs)


def test_random_edits():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    rng = np.random.default_rng(2)
    alphabet = list("ab  \n\t'sé1.") + ["don't ", "  x", "<|endoftext|>", "\u00a0", "漢"]
    pieces = edit_counts.PieceCounter(tokens.default_vocabulary())
    draw = lambda n: "".join(rng.choice(alphabet, n))
    for size in (0, 1, 5, 400, 2500):
        counted = edit_counts.CountedText(draw(size).replace("<|endoftext|>", ""), pieces)
        for _ in range(60):
            a, b = sorted(rng.integers(0, len(counted.text) + 1, 2))
            b = min(b, a + 40)
            new = draw(int(rng.integers(0, 12)))
            counted.edit(int(a), int(b), new if rng.random() < 0.1 else new.replace("<|endoftext|>", ""))
            assert counted.tokens() == len(tokenizer.encode(counted.text, add_special_tokens=False).ids)
            assert counted.tree.total()[0] == len(counted.text)


def test_chunked_ids_equal_whole_ids():
    rng = np.random.default_rng(4)
    encoder = tokens.ChunkEncoder(tokens.default_vocabulary())
    alphabet = list("abcABC   \n\t'.,;!é1") + [" the", " word,", "\u00a0", "\u2003", "漢", "<|endoftext|>", " I'm", " x.y"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 40))))
        assert encoder.encode(text) == encoder.whole(text), repr(text)


def test_mixing(spark, sf, docs):
    got = QUERIES["op9_mixing"](spark, sf).toPandas()
    assert len(got) == len(docs) == got["position"].nunique()
    counts = docs["source"].value_counts()
    weights = mixing.tempered_weights(read(spark, sf, "documents"))
    assert weights == {s: pytest.approx(n ** 0.5) for s, n in counts.items()}
    assert ((got["position"] // mixing.UNIT_ROWS) == got["slot"]).all()
    rows_of = got.groupby(["source", "block"]).size()
    for source, n in counts.items():  # whole blocks but for the last one
        assert sorted(rows_of[source]) == sorted([mixing.BLOCK_ROWS] * (n // mixing.BLOCK_ROWS) + [n % mixing.BLOCK_ROWS] * (n % mixing.BLOCK_ROWS > 0))
    # no slot is left empty while every source has rows, and blocks come in their order
    used = got.groupby("slot")["source"].nunique()
    first_out = min(got[got["source"] == s]["slot"].max() for s in counts.index)
    assert (used == 1).all() and set(range(int(first_out))) <= set(used.index)
    for _, mine in got.sort_values("position").groupby("source"):
        assert mine["block"].is_monotonic_increasing


def brute_edf(counts, period):
    """Earliest deadline first over one period, slot by slot; every deadline must hold."""
    done, out = [0] * len(counts), []
    for slot in range(period):
        ready = [(-(-(done[i] + 1) * period // n), i) for i, n in enumerate(counts) if done[i] < n and done[i] * period // n <= slot]
        due, i = min(ready)
        assert due >= slot + 1
        out.append((i, done[i]))
        done[i] += 1
    return out


def test_period_order(spark):
    cases = [[128, 77, 51], [1, 255], [256], [0, 200, 56], [25] * 9 + [31], [3] * 85 + [1]]
    for counts in cases:
        got = spark.range(1).select(mixing.period_order(F.array(*[F.lit(n).cast("bigint") for n in counts]))).first()[0]
        assert [tuple(x) for x in got] == brute_edf(counts, 256)


@pytest.mark.parametrize("weights", [
    {"big": 0.5, "rare": 0.0007, **{f"s{i:02}": (0.5 - 0.0007) / 18 for i in range(18)}}, {"a": 5, "b": 3, "c": 2},
    {"a": 0.61, "b": 0.17, "c": 0.2, None: 0.02}, {str(i): 1 for i in range(37)}, {"a": 2 ** 0.5, "b": 3 ** 0.5}, {"only": 1}])
def test_mixing_deviates_less_than_a_block(spark, weights):
    """At every slot each source is less than one block (two units) from its exact share, over many periods."""
    total = sum(weights.values())
    slots = 6000
    kind = "source string, n long"
    rows = spark.createDataFrame([(s, int(slots * w / total) + 2) for s, w in weights.items()], kind)
    rows = rows.select("source", F.explode(F.sequence(F.lit(1), "n")))
    plan = mixing.plan_of(rows, weights, 1).toPandas()
    assert plan["slot"].is_unique and set(range(slots)) <= set(plan["slot"])
    plan = plan[plan["slot"] < slots].sort_values("slot")
    names = plan["s"].astype(object).where(plan["s"].notna(), None).to_numpy()
    for s, w in weights.items():
        mine = np.array([n == s for n in names])
        off = np.cumsum(mine) - (np.arange(slots) + 1) * (w / total)
        assert np.abs(off).max() < 2 - 1e-9, s
        assert (plan["k"].to_numpy()[mine] == np.arange(mine.sum())).all()


def test_mixing_of_a_tiny_weight_costs_no_slots_between(spark):
    """400 rows with weights 1 and 1e-6: the plan has the units that there are and nothing for the empty slots."""
    docs = spark.range(400).selectExpr("id as doc_id", "case when id < 200 then 'a' else 'b' end as source")
    got = mixing.mix(docs, {"a": 1.0, "b": 1e-6}).toPandas()
    assert got["position"].notna().all() and got["position"].nunique() == 400
    slots = got[got["source"] == "b"]["slot"]
    assert slots.max() > 20_000_000 and got[got["source"] == "a"]["slot"].max() < 30


def brute_lm(rows):
    uni, pair, train = collections.Counter(), collections.Counter(), 0
    words = lambda t: [*(t or "").encode().lower().split(), b" end"]
    for doc_id, text in rows:
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            w = words(text)
            uni.update(w)
            pair.update(zip([b" start", *w], w))
            train += 1
    n, v = sum(uni.values()), len(uni)
    context = {**uni, b" start": train}
    for doc_id, text in rows:
        base = score = known = 0
        before = b" start"
        for w in words(text):
            p1 = uni[w] / (n + v) if uni[w] else 1 / (n + v + 1)
            base += np.log10((uni[w] + 1) / (n + v + 1))
            known += uni[w] > 0
            h = context.get(before, 0)
            score += np.log10((pair[before, w] + lm_score.PRIOR * p1) / (h + lm_score.PRIOR))
            before = w
        yield doc_id, (len(words(text)), known, n, base, score)


def test_lm(spark, sf, docs):
    rows = list(zip(docs["doc_id"], docs["text"]))
    got = lm_score.lm_scores(read(spark, sf, "documents"), block_bytes=100_000, keys_per_range=10_000).toPandas()
    want = dict(brute_lm(rows))
    assert len(got) == len(docs)
    for r in got.itertuples():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert [r.base_score, r.score] == pytest.approx(want[r.doc_id][3:])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_lm_unknown_words_have_their_own_share(spark):
    """Known words and each unknown one are single outcomes: gibberish is not more likely than clean text."""
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, f"the w{i} is a word{i}") for i in train] + [(held[0], "the w0 is a word1"), (held[1], "qx zv kj pf ww")]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    want = dict(brute_lm(rows))
    assert [got.loc[i, "score"] for i, _ in rows] == pytest.approx([want[i][4] for i, _ in rows])
    uni = collections.Counter(w for i, t in rows if i in train for w in [*t.split(), "end"])
    n, v, k = sum(uni.values()), len(uni), lm_score.PRIOR
    assert got.loc[held[1], "score"] == pytest.approx(
        5 * np.log10(1 / (n + v + 1)) + np.log10(k / (len(train) + k)) + np.log10(uni["end"] / (n + v)))
    assert got.loc[held[0], "score"] > got.loc[held[1], "score"]


def test_lm_is_a_probability():
    """After every context the known words and as many unknown ones sum to at most 1."""
    rng = np.random.default_rng(5)
    texts = [[int(w) for w in rng.zipf(1.5, 12) % 9] for _ in range(40)]
    uni = np.bincount([w for t in texts for w in t], minlength=9)
    uni[8] = 0  # a word out of the training texts stands for each unknown one
    pairs = collections.Counter((a, b) for t in texts for a, b in zip(t, t[1:]) if a < 8 and b < 8)
    n, v = int(uni.sum()), int((uni > 0).sum())
    seen = uni.copy()  # a context's own count: at least that of the pairs that begin with it
    machine = lm_score.Automaton(seen, len(texts), n, v)
    some = np.array(sorted(pairs))
    machine.add_pairs(some[:, 0], some[:, 1], np.array([pairs[tuple(p)] for p in some.tolist()]))
    for h in range(9):
        state = machine.state[h]
        p = [10 ** (machine.arcs[state * 9 + w] if state and state * 9 + w in machine.arcs else machine.root[w] + machine.fail[state])
             for w in range(9)]
        assert sum(p[:8]) + v * p[8] <= 1 + 1e-12


def test_lm_tells_texts_that_occur_twice(spark):
    """Of training texts in words of their own, those that occur twice are the likelier ones."""
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    rng = np.random.default_rng(6)
    text = lambda i: " ".join(f"{w}{i}" if k % 3 else f"c{w % 5}" for k, w in enumerate(rng.integers(0, 99, 30)))
    rows = [(i, text(i)) for i in train]
    rows[1::10] = [(i, t) for (i, _), (_, t) in zip(rows[1::10], rows[0::10])]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")["score"]
    twice = [rows[k][0] for k in range(0, len(rows) - 1) if k % 10 < 2]
    rest = [i for i, _ in rows if i not in twice]
    assert got[twice].quantile(0.1) > got[rest].quantile(0.9)


def test_lm_block_size_plays_no_part(spark, sf):
    a = QUERIES["op10_lm_score"](spark, sf).toPandas().set_index("doc_id").sort_index()
    b = lm_score.lm_scores(read(spark, sf, "documents"), block_bytes=50_000, keys_per_range=5_000).toPandas()
    pd.testing.assert_frame_equal(a, b.set_index("doc_id").sort_index())


def test_pipeline(spark, sf, docs):
    labels = read(spark, sf, "labels")
    frame = read(spark, sf, "documents")
    weights = toxicity.train(frame.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    one = toxicity.scorer(weights)
    left = docs[[one(t) < 0.7 for t in docs["text"]]]
    left = left.sort_values("doc_id").drop_duplicates("text", keep="last")
    found = brute_components(zip(left["doc_id"], left["text"]))
    left = left[[found[d][1] == d for d in left["doc_id"]]]
    out = corpus_pipeline.run(spark, sf).toPandas()
    want = set(brute_pieces(zip(left["doc_id"], left["text"])))
    assert set(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    check_packing(out)


def test_sequences_follow_the_mixture(spark):
    docs = spark.range(600).selectExpr(
        "id as doc_id", "repeat('one ', cast(40 + 37 * (id % 39) as int)) as text", "if(id % 5 = 0, 'a', 'b') as source", "'x' as Mixture_Position")

    def packed(rows):
        out = corpus_pipeline.pack_sequences(spark, rows, "").toPandas().sort_values(["sequence_id", "offset"])
        check_packing(out)
        heads = out[out["offset"] == 0]
        assert heads["position"].is_monotonic_increasing and heads["sequence_id"].tolist() == list(range(len(heads)))
        return out

    mixed = written(corpus_pipeline.mix_sources(spark, docs, ""), "mixed")
    out = packed(mixed)
    places = {r["doc_id"]: r["position"] for r in mixing.mix(docs, mixing.tempered_weights(docs)).collect()}
    assert dict(zip(out["doc_id"], out["position"])) == places
    other = packed(mixing.mixed_rows(docs, {"a": 1.0, "b": 20.0}, position_col="p"))
    together = lambda rows: {tuple(g) for _, g in rows.groupby("sequence_id")["doc_id"]}
    assert together(out) != together(other)


def test_sequences_keep_rows_without_a_position(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, None), (3, "c", 2)], "doc_id long, text string, p int")
    got = packing.pack_documents(docs, limit=1, order_col="p").orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in got] == [3, 3, 1, 1, 1, 2] and got[-1]["position"] is None
    assert packing.pack_documents(docs.limit(0), order_col="p").collect() == []


def test_a_worker_keeps_one_cache():
    worker_cache("test-one")["x"] = 1
    assert worker_cache("test-one") == {"x": 1}
    assert worker_cache("test-two") == {} and worker_cache("test-one") == {}


def test_chunks_end_at_single_line_feeds(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    encoder, rng = tokens.ChunkEncoder(tokens.default_vocabulary()), random.Random(3)
    parts = ["a", "B", "é", "1", " ", " ", "\n", "\n", "\t", "\r", "'s", ".", ",", "\x1c", "word", "日", "\u0301", "  ", "\n\n"]
    for text in ("".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(20000)):
        assert encoder.encode(text) == encoder.whole(text), text
    encoder.encode("see one\nTwo three")
    assert "\nTwo" in encoder.known and len(encoder.known) <= 50


def test_mixed_rows_are_all_rows_in_order(spark, sf):
    frame = read(spark, sf, "documents")
    weights = mixing.tempered_weights(frame)
    got = mixing.mixed_rows(frame, weights).select("doc_id").toPandas()["doc_id"].tolist()
    want = mixing.mix(frame, weights).orderBy("position").toPandas()["doc_id"].tolist()
    assert got == want


def test_mixed_rows_move_texts_once(spark, sf):
    """With no table small enough to be sent whole, one shuffle carries the texts, whatever their number."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = read(spark, sf, "documents")
        got = mixing.mixed_rows(frame, mixing.tempered_weights(frame), position_col="p")
        plan = got._jdf.queryExecution().executedPlan()
        nodes, exchanges = [plan.initialPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                exchanges.append(node.output().toString())
        assert len([e for e in exchanges if "row#" in e or "text#" in e]) == 1
        places = got.select("p").toPandas()["p"]
        assert places.is_monotonic_increasing and places.is_unique and len(places) == frame.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_mixed_rows_of_repeated_ids(spark):
    """Repeated, null and text ids, null sources and sources without a weight: every row once, at the places of the schedule."""
    rows = [(str(i % 500) if i % 50 else None, f"text {i % 900}", (None, "a", "b", "none")[i * 7 % 4]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(5)
    weights = {"a": 3.0, "b": 1.0, None: 0.5}
    got = written(mixing.mixed_rows(frame, weights, position_col="p"), "mixed-repeats")
    assert sorted(map(tuple, got.drop("p").collect()), key=repr) == sorted(rows, key=repr)
    want = mixing.mix(frame, weights)
    assert sorted(map(repr, got.select("doc_id", "source", "p").collect())) == sorted(
        map(repr, want.select("doc_id", "source", F.col("position").alias("p")).collect()))
    ordered = [r["p"] for r in mixing.mixed_rows(frame, weights, position_col="p").collect() if r["p"] is not None]
    assert ordered == sorted(ordered) and len(set(ordered)) == len(ordered) == sum(r[2] != "none" for r in rows)


def test_url_rules():
    assert {r for _, r in url_reputation.RULES} == {"net/", "example.net/en/", "example.com/de/", "org/fr/"}


def test_exact_groups_only_hold_copies(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    got = {(r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(exact_dedup.digests(frame)).collect()}
    assert got == {(2, 2), (5, 2)}


def test_no_text_is_moved_by_exact_dedup(spark, sf):
    """The shuffles of the query carry digests and ids."""
    plan = QUERIES["op8_exact_dedup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "text#" not in plan.replace("text_sha256#", "")


def test_exact_copies_with_a_hot_length(spark):
    """Texts of one length, a third of them equal, and rows that repeat an id with its text."""
    rows = [(i, f"{i % 3000 if i % 3 else 0:06}") for i in range(9000)] + [(5, f"{5:06}"), (9001, "000000")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(frame).collect()}
    assert all(got[i] == (max(want[t]), len(want[t])) for i, t in rows)
    stay = sorted(tuple(r) for r in exact_dedup.drop_copies(frame).collect())
    assert stay == sorted((max(ids), t) for t, ids in want.items())


def test_drop_near_goes_by_id_and_text(spark):
    a, b = "one two three four five six seven", "other words that stand alone in here"
    frame = spark.createDataFrame([(3, a), (7, a), (7, b), (None, a), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.drop_near(frame).collect()), key=str) == sorted([(3, a), (7, b), (None, a), (9, None)], key=str)


def test_leaves_are_split_after_a_large_insertion():
    """An edit after a 300 KB insertion touches a leaf, not the insertion."""
    pieces = edit_counts.PieceCounter(tokens.default_vocabulary())
    counted = edit_counts.CountedText("short text " * 20, pieces)
    counted.edit(5, 5, "some inserted words, " * 15_000)
    before = counted.reencoded
    for at in (100_000, 200_000, 10, len(counted.text) - 3):
        counted.edit(at, at + 1, "x")
    assert counted.reencoded - before < 4 * 3000
    counted.edit(1000, 250_000, "")
    counted.edit(900, 901, "y")
    assert counted.tokens() == pieces.whole(counted.text)
    assert counted.tree.total()[0] == len(counted.text)


def test_registered_domains_follow_the_suffix_table(spark):
    hosts = ["fresh.co.uk", "a.b.site1.co.uk", "co.uk", "uk", "x.example.com", "com", "", "user@h.co.uk:80", "h.co.uk."]
    frame = spark.createDataFrame([(h, 0, 0) for h in hosts], "host string, n long, k long")
    table = spark.createDataFrame([("co.uk",), ("uk",), ("com",), (None,)], "suffix string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in url_reputation.with_domain(frame, table).collect()}
    assert got == {"fresh.co.uk": ("co.uk", "fresh.co.uk"), "a.b.site1.co.uk": ("co.uk", "site1.co.uk"), "co.uk": ("co.uk", "co.uk"),
                   "uk": ("uk", "uk"), "x.example.com": ("com", "example.com"), "com": ("com", "com"), "": ("", ""),
                   "user@h.co.uk:80": ("co.uk", "h.co.uk"), "h.co.uk.": ("co.uk", "h.co.uk")}
    # sites of a common suffix are judged apart: half of them bad, none known for long
    rows = [(i, f"http://site{i}.co.uk/") for i in range(400)] + [(1000, "http://fresh.co.uk/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_reputation.url_verdicts(pages, outcomes, suffixes=table).collect()}
    assert got[1000] == "allow" and got[0] == "allow"
