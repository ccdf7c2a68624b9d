"""Language-model scores by a weighted backoff automaton over words.

Tokens are runs of non-blank bytes, with only A-Z lower-cased, then one end token per text. The model is a bigram model
learned from the training fold. With N training tokens and V distinct ones, a token seen c times has the unigram
probability p(w) = c / (N + V), and each other token 1 / (N + V + 1) of its own, which leaves room for V of them: over
any vocabulary of that size the probabilities sum to at most 1. After a context h seen c(h) times in training

    p(w | h) = (c(h w) + PRIOR * p(w)) / (c(h) + PRIOR)

so that a rare context leans on the unigrams and two occurrences count for more than one. As an automaton: every known
token is a state, with an arc for each known pair that weighs log10 p(w | h); its failure arc weighs
log10 (PRIOR / (c(h) + PRIOR)) and leads to the root, which has an arc for every token. A state that was never a context
is the root itself. A text is scored in one traversal from the start state, which carries the state and adds up weights;
``score`` is the log10 probability of the text.

The model is never gathered in one place. Texts are dealt to blocks of about ``BLOCK_BYTES``; a block sends the sorted
64-bit keys of its distinct tokens and pairs with their training counts, split by ranges of keys; each range sums the
counts over all blocks and answers every block with the totals in the block's own order. A block then builds the part
of the automaton that its texts can reach. So each task holds one block or one range, and a frequent token is one
entry per block.

Null texts count as empty and consist of the end token. Texts of any length are read whole, one block at a time. A row
with a null id belongs to the training fold. Repeated rows are scored each. Without training rows N and V are 0 and every
token has probability 1 (score 0). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns, crc_of, written
from careerlens.llm.shingles import MIX, mixed, word_hashes, words_of

FOLDS, HELD_OUT = 7, 2
#: Weight of the unigrams after a context, in occurrences.
PRIOR = 128.0
BLOCK_BYTES = 8 << 20
KEYS_PER_RANGE = 1_000_000
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, the hash before each, and where each text begins."""
    parts, starts, at = [], [], 0
    for text in texts:
        found = word_hashes(words_of(text or ""))
        parts += [found, np.array([END], np.uint64)]
        starts.append(at)
        at += len(found) + 1
    tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return tokens, before, np.array(starts, np.int64)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(MIX[0]) + mixed(tokens))


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as few bytes as they need; the first byte tells how many."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(body), 8), np.uint8)
    full[:, :width] = body
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or int(counts.max()) <= np.iinfo(k).max)
    return kind[-1].encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[:1].decode()}").astype(np.int64)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Index at which each of ``ranges`` equal ranges of the key space begins in sorted keys."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def blocks(docs: DataFrame, id_col: str, text_col: str, count: int) -> DataFrame:
    rows = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", "text", (F.pmod(crc_of("doc_id"), F.lit(FOLDS)) == HELD_OUT).alias("held_out"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int").alias("block"))


def block_counts(rows: DataFrame, ranges: int) -> DataFrame:
    """kind (1 tokens, 2 pairs), part, block, keys, counts."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        tokens, before, starts = tokens_of(batch["text"])
        lengths = np.diff(np.append(starts, len(tokens)))
        train = np.repeat(~batch["held_out"].to_numpy(bool), lengths)
        out = []
        for kind, values in ((1, tokens), (2, pair_keys(before, tokens))):
            keys, inverse = np.unique(values, return_inverse=True)
            counts = np.bincount(inverse, weights=train, minlength=len(keys)).astype(np.int64)
            cut = range_of(keys, ranges)
            for part in np.flatnonzero(np.diff(cut)):
                mine = slice(cut[part], cut[part + 1])
                out.append((kind, int(part), batch["block"].iloc[0], packed_keys(keys[mine]), packed_counts(counts[mine])))
        return pd.DataFrame(out, columns=["kind", "part", "block", "keys", "counts"])

    return rows.groupBy("block").applyInPandas(run, "kind int, part int, block int, keys binary, counts binary")


def totals(counts: DataFrame) -> DataFrame:
    """kind, part, block, counts over all blocks in the block's order; one row of a part has its n and v."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        keys = [unpacked_keys(x) for x in batch["keys"]]
        known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        each = np.concatenate([unpacked_counts(x) for x in batch["counts"]])
        total = np.bincount(inverse, weights=each, minlength=len(known)).astype(np.int64)
        ends = np.cumsum([len(x) for x in keys])
        out = pd.DataFrame({"kind": batch["kind"], "part": batch["part"], "block": batch["block"], "counts": [
            packed_counts(total[inverse[end - len(x):end]]) for x, end in zip(keys, ends)]})
        out["n"], out["v"] = 0, 0
        out.loc[out.index[0], ["n", "v"]] = int(total.sum()), int((total > 0).sum())
        return out

    kind = "kind int, part int, block int, counts binary, n long, v long"
    return counts.groupBy("kind", "part").applyInPandas(run, kind)


class Automaton:
    """The states and arcs that a block's texts can reach. Words are numbered; state 0 is the root."""

    def __init__(self, unigrams: np.ndarray, start: int, n: int, v: int):
        """``unigrams``: training counts of the words; ``start``: count of the start context."""
        self.words = len(unigrams)
        self.unigram = np.where(unigrams > 0, unigrams / max(1, n + v), 1 / (n + v + 1))
        self.root = np.log10(self.unigram).tolist()
        self.seen = np.append(unigrams, start)
        self.state = np.where(self.seen > 0, np.arange(1, self.words + 2), 0).tolist()
        self.fail = [0.0, *np.log10(PRIOR / (self.seen + PRIOR)).tolist()]
        self.arcs: dict[int, float] = {}

    def add_pairs(self, before: np.ndarray, word: np.ndarray, count: np.ndarray) -> None:
        """Arcs for known pairs; ``before`` is a word number or, for the start, the number of words."""
        weight = np.log10((count + PRIOR * self.unigram[word]) / (self.seen[before] + PRIOR))
        self.arcs.update(zip(((before + 1) * self.words + word).tolist(), weight.tolist()))

    def score(self, text: list[int]) -> float:
        arcs, root, fail, states, words = self.arcs, self.root, self.fail, self.state, self.words
        total, state = 0.0, states[words]
        for w in text:
            arc = arcs.get(state * words + w) if state else None
            if arc is not None:
                total += arc
            else:
                total += root[w] + fail[state]
            state = states[w]
        return total


def score_block(docs: pd.DataFrame, answers: pd.DataFrame, n: int, v: int, start: int) -> pd.DataFrame:
    """Scores of one block's texts; ``answers`` has its totals by kind and part."""
    tokens, before, starts = tokens_of(docs["text"])
    keys, word = np.unique(tokens, return_inverse=True)
    answers = answers.sort_values(["kind", "part"])
    counts = {k: np.concatenate([unpacked_counts(x) for x in g["counts"]]) for k, g in answers.groupby("kind")}
    _, first, pair = np.unique(pair_keys(before, tokens), return_index=True, return_inverse=True)
    machine = Automaton(counts[1], start, n, v)
    prior = np.empty_like(word)
    prior[1:] = word[:-1]
    prior[starts] = len(keys)
    seen = counts[2] > 0
    machine.add_pairs(prior[first][seen], word[first][seen], counts[2][seen])
    c = counts[1][word]
    ends = np.append(starts[1:], len(tokens))
    words = word.tolist()
    score = np.array([machine.score(words[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
    known = np.add.reduceat((c > 0).astype(np.int64), starts)
    return pd.DataFrame({
        "doc_id": docs["doc_id"].astype("Int64"), "held_out": docs["held_out"], "n_tokens": ends - starts,
        "n_known": known, "train_tokens": n,
        "base_score": np.add.reduceat(np.log10((c + 1) / (n + v + 1)), starts),
        "score": score})


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
              keys_per_range: int = KEYS_PER_RANGE) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.count("*")).first()
    count = max(1, -(-(size[0] or 0) // block_bytes))
    # about one distinct pair or token for every seven bytes of a block
    ranges = max(1, (size[0] or 0) // (7 * keys_per_range))
    rows = blocks(docs, id_col, text_col, count)
    answers = written(totals(block_counts(rows, ranges)), "lm-totals")
    one = answers.where("kind = 1").agg(F.sum("n"), F.sum("v")).first()
    n, v = one[0] or 0, one[1] or 0
    start = rows.where("not held_out").count()

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return score_block(docs, answers, n, v, start)

    kind = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
            "score double")
    found = answers.select("block", "kind", "part", "counts")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(run, kind)
