"""SentencePiece encoding against the library: ids, spans, decoded texts, normalisation through compiled maps."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from careerlens.llm import pieces
from careerlens.llm.catalog import QUERIES
from careerlens.llm.common import read

PARTS = list("ab c  \n\t▁é漢字😀ﬁ①　.,'<s></s>0x0A") + ["hello", " world", "▁▁", "\0", "�", "don't ", "x1,y", "  "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def drawn(seed, parts, size=30):
    rng = random.Random(seed)
    return "".join(rng.choice(parts) for _ in range(rng.randrange(size)))


def library_spans(library, text):
    """(begin, end) in bytes of the library's pieces."""
    found = [dict(pieces.fields(v)) for n, v in pieces.fields(library.encode(text, out_type="serialized_proto")) if n == 2]
    return [(f.get(4, 0), f.get(5, 0)) for f in found]


def test_rows(spark, sf, library):
    got = QUERIES["op11_pieces"](spark, sf).toPandas().set_index("doc_id")
    docs = read(spark, sf, "documents").toPandas()
    assert len(got) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"]):
        ids = library.encode(text or "")
        spans = np.array(library_spans(library, text or ""), "<u4").tobytes()
        assert tuple(got.loc[doc_id, ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest(), zlib.crc32(spans))


@pytest.mark.parametrize("marks", [True, False])
def test_random_texts(library, marks):
    model = pieces.model_of()
    parts = [p for p in PARTS if marks or pieces.MARK not in p]
    for seed in range(1500):
        text = drawn(seed, parts)
        ids, back, spans = model.digest(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert back == library.decode(ids.tolist()), repr(text)
        assert [tuple(s) for s in spans.tolist()] == library_spans(library, text), repr(text)
        whole, whole_spans = model.spans(text.encode())
        assert whole == ids.tolist() and whole_spans == [tuple(s) for s in spans.tolist()]


def test_random_ids(library):
    model = pieces.model_of()
    rng = random.Random(1)
    for _ in range(1500):
        ids = [rng.randrange(32000 if rng.random() < 0.3 else 270) for _ in range(rng.randrange(20))]
        assert model.decoded(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_compiled_maps(rule):
    """Longest-prefix normalisation and its alignment equal the library's for its own compiled maps."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = library.serialized_model_proto
    rules = dict(pieces.fields(dict(pieces.fields(proto() if callable(proto) else proto))[3]))
    model = object.__new__(pieces.PieceModel)
    model.user, model.suffix, model.map = None, False, pieces.CharacterMap(rules[2])
    model.dummy, model.squeeze, model.escape = (bool(rules.get(i, 1)) for i in (3, 4, 5))
    assert model.map.longest("①".encode(), 0) == (3, b"1")
    parts = PARTS + list("ＡＢ㍿가각ᄀ́ä") + ["é", "ｶﾞ", " ̈"]
    for seed in range(1000):
        text = drawn(seed, parts, 20)
        plain, source = model.normalised(text.encode())
        want, offsets = library.normalize(text, with_offsets=True)
        assert plain.decode() == want, repr(text)
        # the library tells code points of the source, by code point of the result
        starts = np.cumsum([0, *(len(c.encode()) for c in text)]).tolist()
        at = np.cumsum([0, *(len(c.encode()) for c in want)]).tolist()
        assert [starts.index(source[a]) for a in at] == offsets[:len(at)], repr(text)


def test_long_and_odd_texts(spark, library):
    long = ["漢字" * 20_000, "a" * 50_000, "word " * 50_000, " " * 9_999, "\n" * 9_999, "x,1" * 9_999]
    frame = spark.createDataFrame(list(enumerate(long)) + [(8, None), (None, "null id"), (3, ""), (3, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in pieces.piece_digests(frame).collect()), key=str)
    want = [(i, len(library.encode(t))) for i, t in enumerate(long)] + [(8, 0), (None, len(library.encode("null id"))), (3, 0), (3, 0)]
    assert got == sorted(want, key=str)
    assert pieces.piece_digests(frame.limit(0)).collect() == []


def test_tables_of_pieces(spark):
    frame = spark.createDataFrame([(1, " héllo\nworld", "x"), (2, None, "x"), (3, "a ▁ b", "x")], "doc_id long, text string, ids string")
    raw = {1: " héllo\nworld".encode(), 3: "a ▁ b".encode()}
    spans = pieces.piece_spans(frame).collect()
    for doc_id, text in raw.items():
        mine = sorted((r["position"], r["begin"], r["end"]) for r in spans if r["doc_id"] == doc_id)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert b"".join(text[b:e] for _, b, e in mine) == text
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(frame)).collect()}
    assert back == {1: " héllo\nworld", 2: "", 3: "a   b"}
