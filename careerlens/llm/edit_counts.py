"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A text is split into pre-tokens, which the vocabulary encodes one by one. Leaves of about ``LEAF`` pre-tokens hold the
number of characters and tokens; inner nodes hold sums. An edit replaces a range of characters: splitting starts anew
at the leaf that holds the character ``CONTEXT`` before the range and goes on until a new boundary falls on the end of
an old leaf behind the range. From there on all is as before, since a split depends only on what follows. Only the
leaves in between are encoded and their sums updated.

Leaves that an edit made much too full are split, and emptied ones joined, so that a later edit touches some ``LEAF``
pre-tokens again; the tree above is summed anew from the leaves, which encodes nothing.

Splits look at most ``CONTEXT`` - 1 characters past a pre-token's end. A text that holds a special token's string is
one leaf and encoded whole after each edit. Very long texts are read whole. Null texts count as empty and have no tokens; edits are cut to the text; rows with null ids and
repeated rows are counted like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns, worker_cache
from careerlens.llm.tokens import default_vocabulary

LEAF = 64
CONTEXT = 4
#: Pre-tokens whose counts a worker remembers; beyond it the memory starts anew.
CACHE_PIECES = 400_000

Edit = tuple[int, int, str]


class PieceCounter:
    """Pre-tokens of a text and their numbers of tokens."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        new = [p for p in set(pieces) if p not in known]
        if new:
            if len(known) + len(new) > CACHE_PIECES:
                known.clear()
                new = list(set(pieces))
            for piece, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                known[piece] = len(got.ids)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def counter(path: str | None = None) -> PieceCounter:
    path = path or default_vocabulary()
    kept = worker_cache("piece-counters")
    if path not in kept:
        kept[path] = PieceCounter(path)
    return kept[path]


class SegmentTree:
    """Sums of (characters, tokens) over slots."""

    def __init__(self, leaves: np.ndarray):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size:self.size + len(leaves)] = leaves
        at = self.size
        while at > 1:
            self.sums[at // 2:at] = self.sums[at:2 * at].reshape(-1, 2, 2).sum(axis=1)
            at //= 2
        self.slots = len(leaves)

    def total(self) -> tuple[int, int]:
        return int(self.sums[1, 0]), int(self.sums[1, 1])

    def slot_at(self, char: int) -> tuple[int, int]:
        """The slot that holds a character (the last one at the end) and the slot's first character."""
        at, start = 1, 0
        while at < self.size:
            at *= 2
            if start + self.sums[at, 0] <= char:
                start += int(self.sums[at, 0])
                at += 1
        slot = at - self.size
        if slot >= self.slots:
            slot = self.slots - 1
            start = self.total()[0] - int(self.sums[self.size + slot, 0])
        return slot, start

    def chars(self, slot: int) -> int:
        return int(self.sums[self.size + slot, 0])

    def put(self, slot: int, leaves: np.ndarray) -> None:
        """Replace the slots from ``slot`` on and update the sums above them."""
        low, high = self.size + slot, self.size + slot + len(leaves)
        self.sums[low:high] = leaves
        while low > 1:
            low, high = low // 2, (high + 1) // 2
            self.sums[low:high] = self.sums[2 * low:2 * high].reshape(-1, 2, 2).sum(axis=1)


class CountedText:
    """A text with its tree. ``reencoded`` counts the characters that edits had encoded anew."""

    def __init__(self, text: str, pieces: PieceCounter):
        self.text, self.pieces, self.reencoded = text, pieces, 0
        self.build()

    def build(self) -> None:
        self.plain = not any(s in self.text for s in self.pieces.special)
        if self.plain:
            found = self.pieces.pattern.findall(self.text)
            leaves = self.leaves(found, max(1, -(-len(found) // LEAF)))
        else:
            leaves = np.array([(len(self.text), self.pieces.whole(self.text))])
        self.tree = SegmentTree(leaves)

    def leaves(self, found: list[str], slots: int) -> np.ndarray:
        """Characters and tokens of ``slots`` nearly equal runs of pre-tokens."""
        out = np.zeros((slots, 2), np.int64)
        if found:
            both = np.stack([np.fromiter(map(len, found), np.int64, len(found)), self.pieces.counts(found)], axis=1)
            ends = np.linspace(0, len(found), slots + 1).astype(np.int64)
            sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(both, axis=0)])
            out = sums[ends[1:]] - sums[ends[:-1]]
        return out

    def tokens(self) -> int:
        return self.tree.total()[1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from ``start`` up to ``stop``."""
        start = min(max(0, start), len(self.text))
        stop = min(max(start, stop), len(self.text))
        old = self.text
        self.text = text = old[:start] + new + old[stop:]
        window = text[max(0, start - 64):start + len(new) + 64]
        if not self.plain or any(s in window for s in self.pieces.special):
            self.reencoded += len(text)
            self.build()
            return
        shift = len(text) - len(old)
        first, begin = self.tree.slot_at(max(0, start - CONTEXT))
        last, end = self.tree.slot_at(stop)
        end += self.tree.chars(last)
        found: list[str] = []
        at = begin
        while at < len(text):
            piece = self.pieces.pattern.match(text, at)[0]
            found.append(piece)
            at += len(piece)
            while end + shift < at and last < self.tree.slots - 1:
                last += 1
                end += self.tree.chars(last)
            if at == end + shift:
                break
        else:
            last = self.tree.slots - 1
        self.reencoded += at - begin
        slots, wanted = last - first + 1, max(1, -(-len(found) // LEAF))
        if slots // 4 <= wanted <= 2 * slots:
            self.tree.put(first, self.leaves(found, slots))
        else:
            # too much or too little for these leaves: they are split or joined, the others keep their sums
            old = self.tree.sums[self.tree.size:self.tree.size + self.tree.slots]
            self.tree = SegmentTree(np.concatenate([old[:first], self.leaves(found, wanted), old[last + 1:]]))


def sample_edits(text: str) -> list[Edit]:
    """The query's edits, from the text alone: a cut after the middle, a copy of the start put in at a quarter, an
    added end, and the first character replaced."""
    n = len(text)
    return [(n // 2, n // 2 + min(100, n // 4), ""), (n // 4, n // 4, text[:50]), (n, n + 100, " " + text[n // 3:n // 3 + 80]),
            (0, 1, text[-1:] + "\n")]


def edit_counts(docs: DataFrame, edits: Callable[[str], list[Edit]] = sample_edits, vocabulary: str | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, edited_tokens, edited_chars, reencoded_chars, edited_sha256."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        pieces = counter(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                counted = CountedText(text or "", pieces)
                before = counted.tokens()
                for start, stop, new in edits(counted.text):
                    counted.edit(start, stop, new)
                out.append((doc_id, before, counted.tokens(), len(counted.text), counted.reencoded,
                            hashlib.sha256(counted.text.encode()).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "edited_tokens", "edited_chars",
                                               "reencoded_chars", "edited_sha256"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    kind = ("doc_id long, n_tokens long, edited_tokens long, edited_chars long, reencoded_chars long, "
            "edited_sha256 string")
    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, kind)
