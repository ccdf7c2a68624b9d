"""Keywords as a table: which of any number of keywords each text contains.

Containment has no equality to join on. The keywords travel to the texts as Aho-Corasick automata, in parts of at most
``PART_BYTES`` each, so what a task holds is bounded whatever the table; every part is one pass over the texts, which
are not shuffled. A worker builds a part's automaton once.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 16 << 20


def _parts(keywords: DataFrame, column: str, part_bytes: int) -> Iterator[list[str]]:
    """The distinct lower-case keywords in parts of bounded size; empty ones and nulls are left out."""
    words = keywords.select(F.lower(F.col(column)).alias("w")).where("w <> ''").distinct()
    size = words.agg(F.sum(F.octet_length("w") + 64)).first()[0] or 0
    parts = -(-size // part_bytes)
    for part in range(parts):
        # a part's size is known to be near part_bytes: the hash deals keywords evenly
        mine = words.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == part) if parts > 1 else words
        yield sorted(r["w"] for r in mine.collect())


def _finder(words: list[str], name: str):
    """text -> set of the words in it; kept by the worker under ``name``."""
    kept = sys.modules.setdefault("_careerlens_keywords", types.ModuleType("_careerlens_keywords")).__dict__
    if kept.get("name") != name:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in words:
            machine.add_word(word, word)
        machine.make_automaton()
        kept["name"], kept["machine"] = name, machine
    machine = kept["machine"]
    return lambda text: {word for _, word in machine.iter(text)}


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", keyword: str = "keyword",
                 part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (key, word) for every distinct lower-case keyword that the lower-case text contains.

    Equal to the theta join ``contains(lower(text), lower(keyword))``, once per row of ``texts`` and word. Null texts
    and keywords and empty keywords give nothing.
    """
    kind = dict(texts.dtypes)[key]
    rows = texts.select(F.col(key).alias("__key"), F.lower(F.col(text)).alias("__text")).where("__text is not null")
    out = texts.sparkSession.createDataFrame([], f"`{key}` {kind}, word string")
    for words in _parts(keywords, keyword, part_bytes):
        name = hashlib.md5("\n".join(words).encode()).hexdigest()

        def run(batches: Iterator[pd.DataFrame], words=words, name=name) -> Iterator[pd.DataFrame]:
            find = _finder(words, name)
            for batch in batches:
                found = [sorted(find(t)) for t in batch["__text"]]
                counts = [len(f) for f in found]
                yield pd.DataFrame({
                    key: batch["__key"].repeat(counts).reset_index(drop=True),
                    "word": pd.Series([w for f in found for w in f], dtype=object)})

        out = out.unionByName(rows.mapInPandas(run, f"`{key}` {kind}, word string"))
    return out


def matched_keywords(texts: DataFrame, keywords: DataFrame, key: str, text: str = "text", keyword: str = "keyword",
                     order: str = "ord", part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, matched_keywords): the matching keywords as written, in the order of the table, for texts with a match."""
    hits = keyword_hits(texts, keywords, key, text, keyword, part_bytes)
    named = keywords.select(F.lower(F.col(keyword)).alias("word"), F.struct(order, F.col(keyword).alias("k")).alias("__k"))
    return hits.join(named, "word").groupBy(key).agg(
        F.transform(F.array_sort(F.collect_set("__k")), lambda k: k["k"]).alias("matched_keywords"))
