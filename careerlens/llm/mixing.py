"""Mixing sources to target weights as a Pfair schedule, in DataFrame functions only.

A source's rows form blocks, and a block two units of ``UNIT_ROWS`` rows; slots hold units. Unit j of a source with share n
of a period of P slots is released at slot floor(j * P / n) and due by slot ceil((j + 1) * P / n); every slot goes to the
released unit with the earliest deadline. Periods of ``PERIOD`` slots are worked out each on its own, in parallel: by
the end of a period at slot t a source has got floor(w * t) units, and those with the largest remainders one more, so
that all slots are taken. Weights are taken as whole numbers of 10^15ths, which sum to it.

At the ends of periods each source is less than one unit from its exact share, and inside a period less than one unit
from the line between the ends: together less than two units, that is one block, at every slot.

Every row keeps its place: a source that runs out leaves its slots empty and the others go on in their proportions;
no row is dropped or repeated. Periods that hold no row are left out before anything is scheduled, so their number costs a
number each. The driver holds the weights and one count per source: a mixture has as many sources as somebody gave
weights to. Null sources form a source of their own. Rows of a source without a weight get a null slot. Rows are ordered
within a source by a hash of their id, so copies and long runs are spread. Texts are not read, whatever their length. An
empty table gives an empty result; ties (equal ids) are ordered arbitrarily among themselves. Helper columns take free
names.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlens.llm.common import bucket_of, columns, numbered, written

UNITS = 2
UNIT_ROWS = 8
BLOCK_ROWS = UNITS * UNIT_ROWS
PERIOD = 256
WHOLE = 10**15


def whole_shares(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The weights as whole numbers that sum to ``WHOLE``, by largest remainder."""
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * WHOLE / total for s, w in weights.items()}
    shares = {s: max(1, int(x)) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s is None, s or ""))
    for s in rest[:max(0, WHOLE - sum(shares.values()))]:
        shares[s] += 1
    return shares


def quotas(t: Column, shares: Column) -> Column:
    """Units that each source has got before slot ``t``: floors, and one more for the largest remainders."""
    # decimals hold the products exactly
    def part(share: Column, i: Column) -> Column:
        product = t.cast("decimal(19,0)") * share.cast("decimal(18,0)")
        floor = F.call_function("div", product, F.lit(WHOLE).cast("decimal(18,0)")).cast("bigint")
        return F.struct(floor.alias("floor"), (product % F.lit(WHOLE).cast("decimal(18,0)")).cast("bigint").alias("rest"),
                        i.alias("i"))

    parts = F.transform(shares, part)
    left = t - F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: n + x["floor"])
    order = F.array_sort(F.transform(parts, lambda x: F.struct((-x["rest"]).alias("r"), x["i"].alias("i"))))
    return F.transform(parts, lambda x: x["floor"] + (
        F.array_position(order, F.struct((-x["rest"]).alias("r"), x["i"].alias("i"))) <= left).cast("bigint"))


def period_order(counts: Column, period: int = PERIOD) -> Column:
    """(source, unit) of each slot of a period in which source i has ``counts[i]`` units: earliest deadline first among
    released units."""
    size = F.lit(period).cast("bigint")
    state = F.struct(F.transform(counts, lambda n: F.lit(0).cast("bigint")).alias("done"),
                     F.array().cast("array<struct<i:int,j:bigint>>").alias("order"))

    def step(held: Column, slot: Column) -> Column:
        # floor(j * P / n) <= slot: released; ceil((j + 1) * P / n): the deadline
        def choice(n: Column, i: Column) -> Column:
            j = F.get(held["done"], i)
            due = F.call_function("div", (j + 1) * size + n - 1, n)
            return F.when((j < n) & (F.call_function("div", j * size, n) <= slot), F.struct(due.alias("due"), i.alias("i"), j.alias("j")))

        safe = F.transform(counts, lambda n: F.greatest(n, F.lit(1).cast("bigint")))
        options = F.transform(safe, lambda n, i: F.when(F.get(counts, i) > 0, choice(n, i)))
        chosen = F.array_min(F.filter(options, lambda o: o.isNotNull()))
        done = F.transform(held["done"], lambda j, i: j + (i == chosen["i"]).cast("bigint"))
        return F.struct(done.alias("done"), F.concat(
            held["order"], F.array(F.struct(chosen["i"].cast("int").alias("i"), chosen["j"].alias("j")))).alias("order"))

    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), size - 1), state, step, lambda held: held["order"])


def plan_of(rows: DataFrame, weights: Mapping[str | None, float], unit_rows: int, period: int = PERIOD) -> DataFrame:
    """s, k, slot of every unit that has rows."""
    spark = rows.sparkSession
    kind = "s string, k bigint, slot bigint"
    shares = whole_shares(weights)
    names = sorted(shares, key=lambda s: (-shares[s], s is None, s or ""))
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect() if r["source"] in shares}
    if not counts:
        return spark.createDataFrame([], kind)
    units = {s: -(-n // unit_rows) for s, n in counts.items()}
    # a unit k of share w is over by slot (k + 1) / w and one more period
    periods = max(-(-(n + 1) * WHOLE // (shares[s] * period)) for s, n in units.items()) + 1
    of_names = F.array(*[F.lit(s).cast("string") for s in names])
    of_shares = F.array(*[F.lit(shares[s]).cast("bigint") for s in names])
    of_units = F.array(*[F.lit(units.get(s, 0)).cast("bigint") for s in names])
    start = F.col("id") * period
    found = spark.range(periods).select(start.alias("start"), quotas(start, of_shares).alias("had"),
                                        quotas(start + period, of_shares).alias("has"))
    found = found.select("start", "had", F.zip_with("has", "had", lambda b, a: b - a).alias("n"))
    used = F.exists(F.arrays_zip(F.col("n"), F.col("had"), of_units.alias("u")), lambda x: (x["n"] > 0) & (x["had"] < x["u"]))
    found = found.where(used)
    found = found.select("start", "had", F.posexplode(period_order(F.col("n"), period)).alias("at", "x"))
    k = F.get("had", F.col("x.i")) + F.col("x.j")
    found = found.select(F.get(of_names, F.col("x.i")).alias("s"), k.alias("k"), (F.col("start") + F.col("at")).alias("slot"),
                         F.get(of_units, F.col("x.i")).alias("u"))
    return found.where("k < u").drop("u")


def spread_of() -> Column:
    """The number that deals a source's rows to buckets."""
    return F.xxhash64("doc_id", F.lit(7))


def schedule(rows: DataFrame, weights: Mapping[str | None, float], block_rows: int = BLOCK_ROWS, count: int | None = None) -> DataFrame:
    """Add block, slot and position to rows that have doc_id and source. ``count`` is their number, if known."""
    unit_rows = max(1, block_rows // UNITS)
    # written: sampling for ranges and retried tasks read the schedule and do not work it out again
    plan = written(plan_of(rows, weights, unit_rows), "mixing-plan")
    rows = numbered(rows.withColumn("_h", F.xxhash64("doc_id")), ["source"], ["_h", "doc_id"],
                    spread_of(), "_rank", count).drop("_h")
    rows = rows.withColumn("_unit", F.floor(F.col("_rank") / unit_rows).cast("long"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("_unit") == F.col("k")), "left")
    place = (F.col("slot") * unit_rows + F.pmod("_rank", F.lit(unit_rows))).cast("long")
    block = F.floor(F.col("_unit") / UNITS).cast("long")
    return rows.withColumn("block", block).withColumn("position", place).drop("_rank", "_unit", "k", "s")


def mix(docs: DataFrame, weights: Mapping[str | None, float], block_rows: int = BLOCK_ROWS,
        id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source, block, slot, position. Ordered by position the rows are the mixture."""
    rows = columns(docs, doc_id=id_col, source=source_col)
    rows = rows.select("doc_id", F.col("source").cast("string").alias("source"))
    return schedule(rows, weights, block_rows).select("doc_id", "source", "block", "slot", "position")


def same_row(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Equal keys, nulls included."""
    on = F.lit(True)
    for key in keys:
        on = on & left[key].eqNullSafe(right[key])
    return on


def placed_rows(rows: DataFrame, weights: Mapping[str | None, float], block_rows: int, count: int) -> DataFrame:
    """doc_id, source, position, part of every row, written once. Parts are ranges of positions, numbered in their order."""
    key = [bucket_of(spread_of(), count), F.xxhash64("doc_id"), F.col("doc_id")]
    placed = schedule(rows.select("doc_id", "source"), weights, block_rows, count).select("doc_id", "source", "position")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(placed.repartitionByRange(parts, "position", *key).withColumn("part", F.spark_partition_id()), "mixing-places")


def with_part(rows: DataFrame, placed: DataFrame, count: int) -> DataFrame:
    """Add to rows, whose ids are unique within a source, the part that holds their position.

    Positions of a source rise with bucket, hash and id, so a part holds one stretch of them. The firsts of all stretches are sent to
    the rows: one for each source, and bucket or part."""
    key = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"))
    bucket = bucket_of(spread_of(), count).alias("_b")
    firsts = placed.groupBy("source", bucket, "part").agg(F.min(key).alias("first"))
    firsts = written(firsts.groupBy("source", "_b").agg(F.sort_array(F.collect_list(F.struct("first", "part"))).alias("_firsts")),
                     "mixing-parts")
    rows = rows.withColumn("_b", bucket)
    found = rows.join(F.broadcast(firsts), same_row(rows, firsts, "source", "_b"), "left").select(
        *[rows[c] for c in rows.columns], firsts["_firsts"])
    return found.withColumn("part", F.element_at(F.filter("_firsts", lambda f: f["first"] <= key), -1)["part"]).drop("_b", "_firsts")


def repeats_placed(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """part, source, doc_id, row, position of rows whose ids are repeated within a source: the n-th of the rows takes the n-th
    place. They are written, so that a retried task finds each row at its place."""
    nth = Window.partitionBy("source", "doc_id")
    rows = rows.withColumn("_nth", F.row_number().over(nth.orderBy(F.lit(0))))
    placed = placed.withColumn("_nth", F.row_number().over(nth.orderBy("position", "part")))
    both = rows.join(placed, same_row(rows, placed, "source", "doc_id", "_nth"))
    return written(both.select("part", rows["source"], rows["doc_id"], "row", "position"), "mixing-repeats")


def mixed_rows(docs: DataFrame, weights: Mapping[str | None, float], block_rows: int = BLOCK_ROWS,
               id_col: str = "doc_id", source_col: str = "source", position_col: str | None = None) -> DataFrame:
    """All rows with all their columns in the order of the mixture, by ranges of positions. ``position_col`` names a last
    column for the positions.

    Ids and sources alone are scheduled. A row's part of the mixture is looked up by its id, and the row is moved there once,
    together with its position. Rows that repeat an id of their source are few or none; they are moved three times."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.col(f"`{source_col}`").cast("string").alias("source"))
    count = rows.count()
    placed = placed_rows(rows, weights, block_rows, count)
    again = written(placed.groupBy("source", "doc_id").count().where("count > 1").select("source", "doc_id"), "mixing-again")
    once, places, repeats = rows, placed, None
    if not again.isEmpty():
        of_rows, of_places = same_row(rows, again, "source", "doc_id"), same_row(placed, again, "source", "doc_id")
        once, places = rows.join(again, of_rows, "left_anti"), placed.join(again, of_places, "left_anti")
        repeats = repeats_placed(rows.join(again, of_rows, "left_semi"), placed.join(again, of_places, "left_semi"))
    kept = ["part", "source", "doc_id", "row", "position"]
    moved = with_part(once, places, count).withColumn("position", F.lit(None).cast("bigint")).select(kept).unionByName(
        places.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)).select(kept))
    if repeats is not None:
        moved = moved.unionByName(repeats)
    # rows of one id and source lie in one part: the window moves nothing
    own = F.max("position").over(Window.partitionBy("part", "source", "doc_id"))
    moved = moved.repartitionByRange("part").withColumn("position", F.coalesce("position", own)).where("row is not null")
    return moved.sortWithinPartitions("position").select(
        "row.*", *([F.col("position").alias(position_col)] if position_col else []))


def tempered_weights(docs: DataFrame, power: float = 0.5, source_col: str = "source") -> dict[str | None, float]:
    """Target weights from counts: rows of a source to ``power``. One row per source comes to the driver."""
    counts = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("source")).count()
    return {r["source"]: float(r["count"]) ** power for r in counts.collect()}
