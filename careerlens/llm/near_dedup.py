"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

A document's set holds its distinct shingles of five words. Documents with equal sets form a class first; classes are
compared through one representative. Bands of a MinHash signature deal classes to buckets. A bucket of up to
``small_bucket`` classes compares all of them; in a larger one every class is compared with ``pivots`` classes: those
which share most with the rest, as counted by the sizes of all their buckets. Further rounds take other pivots in
buckets that still hold several components, until a round adds no link. Then one exhaustive round takes what is left:
in every large bucket that still holds several components, all classes of different components are compared, block
of ``block`` classes by block, and confirmed in the same task, so only links leave it. A pair is compared where its
first common band is, and not at all if that was a small bucket.

A candidate's signatures are compared in batches of components. After each batch the number of agreements gives a beta
posterior (uniform prior) of the similarity; where the chance that it reaches the threshold is below ``miss``, the
pair is given up. Survivors are confirmed on their full sets of shingles. The chance that bands and pruning lose a
link at similarity 0.85 is below 1e-4 for a pair of documents, and a component is lost only with all its links.

Null and empty texts have empty sets and are linked with nothing. Very long texts are shingled whole. Rows that repeat an
id with several texts are judged each by its text; where that id is the least of two groups of copies, these count as
linked. A row with a null id is linked with nothing and kept. Equal texts are linked; the
least id of a component stays. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careerlens.llm.common import columns, written
from careerlens.llm.components import components
from careerlens.llm.shingles import permutations, shingles_of, signature, word_hashes, words_of

WIDTH = 5
THRESHOLD = (85, 100)
PERMUTATIONS = 128
BANDS = 48
ROWS = 8
SMALL_BUCKET = 16
PIVOTS = 4
MISS = 1e-5
BATCH = 16
BLOCK = 256


def band_rows(bands: int = BANDS, rows: int = ROWS, count: int = PERMUTATIONS, seed: int = 5) -> np.ndarray:
    """The signature components of each band: ``rows`` of ``count``, drawn anew for every band."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(count)[:rows] for _ in range(bands)])


def least_agreements(threshold: float, miss: float, count: int, batch: int) -> np.ndarray:
    """For each number of compared components, the fewest agreements that are not given up.

    With m of n agreeing the posterior of the similarity is Beta(m + 1, n - m + 1), whose upper tail at the threshold
    equals the chance of at most m successes in n + 1 trials.
    """
    from math import comb

    out = []
    for n in range(batch, count + 1, batch):
        tail, m = 0.0, -1
        while m < n:
            tail += comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            if tail >= miss:
                break
            m += 1
        out.append(m + 1)
    return np.array(out)


def survive(left: np.ndarray, right: np.ndarray, least: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Which pairs of signatures (rows of both arrays) are left after batchwise pruning."""
    alive = np.arange(len(left))
    agree = np.zeros(len(left), np.int64)
    for step, few in enumerate(least):
        part = slice(step * batch, (step + 1) * batch)
        agree[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[agree[alive] >= few]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, content (a hash of the text), n_shingles, two 64-bit hashes of the whole set, signature, band keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        a, b = permutations(PERMUTATIONS)
        bands = band_rows()
        for batch in batches:
            out = []
            for doc_id, content, text in zip(batch["doc_id"], batch["content"], batch["text"]):
                found = shingles_of(word_hashes(words_of(text or "")), width)
                raw = found.tobytes()
                sig = signature(found, a, b)
                keys = [xxh64_intdigest(sig[r].tobytes(), i) for i, r in enumerate(bands)] if len(found) else []
                out.append((doc_id, content, len(found), xxh64_intdigest(raw, 1), xxh64_intdigest(raw, 2), sig.tobytes(),
                            np.array(keys, np.uint64).astype(np.int64)))
            frame = pd.DataFrame(out, columns=["doc_id", "content", "n_shingles", "h1", "h2", "sig", "bands"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            for c in ("h1", "h2"):
                frame[c] = frame[c].astype("uint64").astype("int64")
            yield frame

    rows = columns(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    return rows.mapInPandas(run, "doc_id long, content long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>")


def prune(pairs: DataFrame, threshold: float, miss: float = MISS) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that survive the sequential comparison, without their signatures."""
    least = least_agreements(threshold, miss, PERMUTATIONS, BATCH)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                both = [np.frombuffer(b"".join(batch[c]), np.uint32).reshape(len(batch), -1) for c in ("sig_a", "sig_b")]
                yield batch.loc[survive(*both, least), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and its sorted distinct shingles as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "found": [
                shingles_of(word_hashes(words_of(t or "")), width).tobytes() for t in batch["text"]]})

    return docs.mapInPandas(run, "doc_id long, found binary")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    part, whole = threshold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    left = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def cross_links(rows: DataFrame, reps: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD,
                miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes of different components that share a bucket.

    ``rows`` has key, size, rep and component, ``reps`` rep, sig and bands, ``sets`` doc_id and found. A bucket's
    classes are dealt to blocks by a hash; every two blocks meet in a group of their own, which is all a task holds.
    """
    part, whole = threshold
    least = least_agreements(part / whole, miss, PERMUTATIONS, BATCH)
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("x", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "x", "rep", "component")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rep, of, x = (group[c].to_numpy(np.int64) for c in ("rep", "component", "x"))
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), -1)
        bands = np.stack(group["bands"].to_list())
        found = [np.frombuffer(f, np.uint64) for f in group["found"]]
        n = np.array([len(f) for f in found])
        key, lo, hi = (group[c].iloc[0] for c in ("key", "lo", "hi"))
        right = np.flatnonzero(x == hi)
        out = []
        for i in np.flatnonzero(x == lo):
            j = right[(of[right] != of[i]) & ((right > i) | (lo != hi))]
            j = j[whole * np.minimum(n[i], n[j]) >= part * np.maximum(n[i], n[j])]
            if len(j):
                first = (bands[j] == bands[i]).argmax(axis=1)
                j = j[bands[j, first] == key]
                j = j[survive(np.broadcast_to(sig[i], (len(j), PERMUTATIONS)), sig[j], least)]
            for k in j:
                both = len(np.intersect1d(found[i], found[k], assume_unique=True))
                if whole * both >= part * (n[i] + n[k] - both):
                    out.append((max(rep[i], rep[k]), min(rep[i], rep[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows = rows.join(reps, "rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    return rows.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def representatives(marks: DataFrame) -> DataFrame:
    """One row per class of equal, non-empty sets: rep (its least id), sig, bands."""
    there = marks.where("n_shingles > 0 and doc_id is not null")
    least = there.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("r"))
    return least.select(F.col("r.doc_id").alias("rep"), F.col("r.sig").alias("sig"), F.col("r.bands").alias("bands"))


def members(marks: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id, content, n_shingles, component_id, kept of every row, from its class and the class's component."""
    rows = marks.select("doc_id", "content", "n_shingles", "h1", "h2")
    there = rows.where("n_shingles > 0 and doc_id is not null")
    classes = there.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    linked = there.join(classes, ["h1", "h2"]).select("doc_id", "content", "n_shingles", "component_id")
    alone = rows.where("not (n_shingles > 0 and doc_id is not null)")
    out = linked.unionByName(alone.select("doc_id", "content", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The sketches, written once: every later step reads columns of them."""
    return written(sketches(docs, id_col, text_col, width), "sketches")


def links_of(marks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: tuple[int, int] = THRESHOLD, width: int = WIDTH, small_bucket: int = SMALL_BUCKET,
             pivots: int = PIVOTS, miss: float = MISS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (a, b) of class representatives and their components."""
    docs = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reps = representatives(marks)
    level = threshold[0] / threshold[1]
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(keyed.join(sizes, "key"), "buckets")

    # the classes that share most buckets' rows come first as pivots
    weight = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    shared = shared.join(weight, "rep")
    sigs = reps.select("rep", "sig")
    links: DataFrame | None = None
    label: DataFrame | None = None

    def sets_of(reps_wanted: DataFrame) -> DataFrame:
        # written first, so that the plan of the join knows how small the list is and need not move the texts
        wanted = written(reps_wanted.distinct().toDF("doc_id"), "wanted")
        sets = shingle_sets(docs.join(wanted, "doc_id", "left_semi"), width)
        return sets.dropDuplicates(["doc_id", "found"])

    def unresolved() -> DataFrame:
        at = shared.where(F.col("size") > small_bucket)
        at = at.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
        # written once: the list of open buckets, the pivots and the candidates all read it
        at = written(at.withColumn("component", F.coalesce("component", "rep")), "labelled")
        several = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        return written(at.join(several.where("lo < hi").select("key"), "key", "left_semi"), "unresolved")

    known = taken = 0
    left = None
    while True:
        at = shared.withColumn("component", F.col("rep")) if label is None else (left := unresolved())
        order = Window.partitionBy("key").orderBy(F.desc("weight"), "rep")
        ahead = at.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(small_bucket, pivots + taken))
        ahead = ahead.where((F.col("size") <= small_bucket) | F.col("place").between(taken + 1, taken + pivots))
        ahead = ahead.select("key", F.col("rep").alias("p"), F.col("component").alias("pc"), F.col("weight").alias("pw"))
        found = at.join(ahead, "key").where("component <> pc").where(
            (F.col("weight") < F.col("pw")) | (F.col("weight") == F.col("pw")) & (F.col("p") < F.col("rep"))
            | F.lit(label is not None))
        found = found.select(F.greatest("rep", "p").alias("a"), F.least("rep", "p").alias("b")).distinct()
        found = found.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
        alive = written(prune(found, level, miss), "candidates")
        good = confirm(alive, sets_of(alive.select("a").union(alive.select("b"))), threshold)
        links = written(good if links is None else links.union(good), "links")
        count = links.count()
        if label is not None and count == known:
            break
        known, taken = count, taken + pivots
        label = components(links)

    # the last round added no link, so its buckets are still those that hold several components
    rest = left.select("key", "size", "rep", "component")
    if rest.isEmpty():
        return links, label
    more = written(cross_links(rest, reps, sets_of(rest.select("rep")), threshold, miss, block), "links")
    if more.isEmpty():
        return links, label
    links = written(links.union(more).distinct(), "links")
    return links, components(links)


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: tuple[int, int] = THRESHOLD, width: int = WIDTH, small_bucket: int = SMALL_BUCKET,
              pivots: int = PIVOTS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, content, n_shingles, component_id, kept."""
    marks = sketch_table(docs, id_col, text_col, width)
    _, label = links_of(marks, docs, id_col, text_col, threshold, width, small_bucket, pivots, miss, block)
    return members(marks, label)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. ``options`` are those of :func:`near_rows`."""
    return near_rows(docs, id_col, text_col, **options).drop("content")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. A row goes by its id and text: another text of the same id stays."""
    gone = near_rows(docs, id_col, text_col).where("not kept").select(
        F.col("doc_id").alias("gone_id"), F.col("content").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("content"))
    gone = written(gone, "gone")
    return rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("content") == F.col("gone")), "left_anti").select("row.*")
