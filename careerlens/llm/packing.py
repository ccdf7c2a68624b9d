"""Best-fit packing of token sequences by exact-complement hashing.

Documents are cut from the end into pieces of at most ``limit`` tokens, so that only a document's first piece may be
shorter. Packing needs only how many pieces of each length there are: a table of at most ``limit`` counts. For the
longest length left, the gap of its sequence is looked up among single lengths, then pair sums, then triple sums of the
lengths still available, and a combination that fills the gap exactly is used as often as the counts allow. Where no
combination fits, the longest available piece that fits is taken (best fit) and the rest of the gap is looked up again.
The outcome is a list of runs (pattern, repetitions), again bounded by the number of lengths. Pieces are numbered
within their length and find their sequence and offset by that number.

Numbers within a length come from bucket counts, so a length that holds most pieces is not brought into one task.
Null texts count as empty and give one piece that holds the end token. Repeated rows and rows with null ids are packed
like others; they get pieces of their own. An empty table gives an empty result. Other columns are ignored.

With an order column the pieces of each length are numbered by it, so those that lie close in the order go to neighbouring
sequences of a run, and sequences are numbered by the place of their first, longest piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import buckets_for, columns, numbered, written
from careerlens.llm.tokens import default_vocabulary, encoder

LIMIT = 2048
END_ID = 0


def token_pieces(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """Pieces of whole texts: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids and the position, which is
    the value of a whole-number column."""
    path = vocabulary or default_vocabulary()
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for batch in batches:
            out = []
            for doc_id, text, *place in zip(*(batch[c] for c in batch.columns)):
                ids = encode(text or "") + end
                total = len(ids) // 4
                at = 0
                for piece, stop in enumerate(range((total - 1) % limit + 1, total + 1, limit)):
                    part = ids[4 * at:4 * stop]
                    out.append((doc_id, piece, at, stop - at, zlib.crc32(part), *((part,) if with_ids else ()), *place))
                    at = stop
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(("ids",) if with_ids else ()), *batch.columns[2:]]
            frame = pd.DataFrame(out, columns=names)
            for c in ("doc_id", *batch.columns[2:]):
                frame[c] = frame[c].astype("Int64")
            yield frame

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "") + (", position long" if order_col else "")
    rows = columns(docs, doc_id=id_col, text=text_col, **({"position": order_col} if order_col else {}))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("long").alias(c) for c in rows.columns[2:]])
    return rows.mapInPandas(run, kind)


def fill(gap: int, left: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, or None. ``left`` counts what is available."""
    if left[gap]:
        return (gap,)
    there = left > 0

    def pair(total: int, most: int) -> tuple[int, int] | None:
        longer = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        hit = np.flatnonzero(there[longer] & there[total - longer]
                             & ((longer * 2 != total) | (left[longer] > 1)))
        return (int(longer[hit[0]]), total - int(longer[hit[0]])) if len(hit) else None

    if found := pair(gap, gap):
        return found
    for a in np.flatnonzero(there[:gap - 1])[::-1]:
        a = int(a)
        left[a] -= 1
        there[a] = left[a] > 0
        found = pair(gap - a, min(a, gap - a))
        left[a] += 1
        there[a] = True
        if found:
            return (a, *found)
    return None


def pack_counts(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repetitions) that use ``counts[length]`` pieces of each length exactly."""
    left = np.asarray(counts, np.int64).copy()
    runs: list[tuple[tuple[int, ...], int]] = []
    for longest in range(limit, 0, -1):
        while left[longest] > 0:
            pattern = [longest]
            left[longest] -= 1
            gap = limit - longest
            while gap > 0:
                found = fill(gap, left)
                if found is None:
                    fits = np.flatnonzero(left[:gap + 1])
                    if not len(fits):
                        break
                    found = (int(fits[-1]),)
                for x in found:
                    left[x] -= 1
                    gap -= x
                pattern += found
            lengths, each = np.unique(pattern, return_counts=True)
            more = int((left[lengths] // each).min())
            left[lengths] -= more * each
            runs.append((tuple(pattern), more + 1))
    return runs


def run_table(runs: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, ranges of piece numbers: from, per (pieces of it in a sequence), first sequence, offset of the first."""
    used: dict[int, int] = {}
    rows = []
    first = 0
    for pattern, times in runs:
        offset = 0
        for length in sorted(set(pattern), key=pattern.index):
            per = pattern.count(length)
            start = used.get(length, 0)
            rows.append((length, start, per, first, offset))
            used[length] = start + per * times
            offset += per * length
        first += times
    return pd.DataFrame(rows, columns=["length", "from", "per", "first", "offset"])


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to a (written) table of pieces. A column ``position`` of it is the order to keep."""
    counts = np.zeros(limit + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``limit`` rows
        counts[row["length"]] = row["count"]
    runs = pack_counts(counts, limit)
    table = run_table(runs).sort_values(["length", "from"])
    bounds = np.searchsorted(table["length"].to_numpy(), np.arange(limit + 2))
    cut = {c: table[c].to_numpy(np.int64) for c in table.columns}
    given = pieces.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["length"].to_numpy(np.int64)
            number = batch.pop("_number").to_numpy(np.int64)
            at = np.zeros(len(batch), np.int64)
            for x in np.unique(length):
                mine = length == x
                lo, hi = bounds[x], bounds[x + 1]
                at[mine] = lo + np.searchsorted(cut["from"][lo:hi], number[mine], "right") - 1
            ahead = number - cut["from"][at]
            batch["sequence_id"] = cut["first"][at] + ahead // cut["per"][at]
            batch["offset"] = cut["offset"][at] + ahead % cut["per"][at] * length
            yield batch

    total, ties = int(counts.sum()), ["doc_id", "piece", "ids_crc32"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    kind = f"{kind}, sequence_id long, offset long"
    if "position" not in given:
        rows = numbered(pieces, ["length"], ties, F.xxhash64(*ties), "_number", total)
        return rows.select(*given, "_number").mapInPandas(place, kind)

    # ranges of positions are the buckets; rows without one come last
    end = (pieces.agg(F.max("position").alias("last")).first()["last"] or 0) + 1
    at = F.coalesce("position", F.lit(end))
    bucket = F.floor(at / F.lit(float(end + 1)) * buckets_for(total))
    rows = numbered(pieces, ["length"], [at, *ties], bucket, "_number", total)
    rows = written(rows.select(*given, "_number").mapInPandas(place, kind), "placed")
    heads = rows.where(F.col("offset") == 0).select("sequence_id", "position")
    sequences = sum(times for _, times in runs)
    bucket = F.floor(at / F.lit(float(end + 1)) * buckets_for(sequences))
    heads = numbered(heads, [], [at, "sequence_id"], bucket, "_place", sequences).select("sequence_id", "_place")
    return rows.join(heads, "sequence_id").select(*given, F.col("_place").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, order_col: str | None = None) -> DataFrame:
    """Pieces of all documents with their places. The pieces are written once, as their counts steer the packing."""
    return pack(written(token_pieces(docs, vocabulary, limit, order_col=order_col), "pieces"), limit)
