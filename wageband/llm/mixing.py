"""Interleave sources by target weight with Pfair windows and earliest-deadline-first slots.

Every source gets whole units of a cycle of ``cycle`` slots, in proportion to its target weight.
Its k-th block (from 0) has the window [floor(k * cycle / units), ceil((k + 1) * cycle / units)):
it is released at the start and due by the end. Each slot goes to the released block with the
earliest deadline, ties to the source that sorts first. As the units add up to the cycle, every
block runs inside its window, so after any number of slots a source is less than one block away
from its exact share. The cycle repeats, so a schedule of one cycle serves any number of blocks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wageband.llm.common import let

BLOCK_ROWS = 64
CYCLE = 1000
SHARE_POWER = 0.5


def _key(source: Column) -> Column:
    """Sources as text, a null source being one of its own."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def source_units(rows: DataFrame, source: str, weights: Mapping[str | None, float] | None = None,
                 cycle: int = CYCLE, power: float = SHARE_POWER) -> DataFrame:
    """Slots per cycle of every source: ``_source``, ``_units``, adding up to the cycle's slots.

    Without ``weights`` a source weighs the given power of its row count, which lifts small
    sources. One slot per source is set aside, so that each gets on in every cycle; the rest goes
    out by largest remainder, ties to the source that sorts first. The cycle grows to ten slots
    per source when there are many sources. One row per source, whatever the table's size.
    """
    counts = rows.groupBy(_key(F.col(source)).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        weighed = counts.withColumn("_w", F.pow(F.col("_n").cast("double"), F.lit(power)))
    else:
        given = rows.sparkSession.createDataFrame(
            [("0" if name is None else f"1{name}", float(w)) for name, w in weights.items()],
            "_source STRING, _w DOUBLE")
        weighed = counts.join(F.broadcast(given), "_source", "left").withColumn(
            "_w", F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.0)))
    # One list of sources, so that sums of fractions have one order.
    listed = weighed.agg(
        F.sort_array(F.collect_list(F.struct("_source", "_w"))).alias("l")).filter("size(l) > 0")
    total = F.aggregate(F.col("l"), F.lit(0.0), lambda a, x: a + x["_w"])
    sized = listed.select(
        "l", total.alias("t"), F.greatest(F.lit(cycle), F.lit(10) * F.size("l")).alias("c"))
    exact = sized.select("c", F.size("l").alias("k"), "t", F.inline("l")).withColumn(
        "_exact", F.when(F.col("t") > 0, F.col("_w") / F.col("t") * (F.col("c") - F.col("k")))
        .otherwise((F.col("c") - F.col("k")) / F.col("k")))
    whole = exact.withColumn("_floor", F.floor("_exact"))
    spare = W.partitionBy("c").orderBy((F.col("_exact") - F.col("_floor")).desc(), "_source")
    return whole.withColumns({
        "_left": F.col("c") - F.col("k") - F.sum("_floor").over(W.partitionBy("c")),
        "_place": F.row_number().over(spare),
    }).select(
        "_source", F.col("c").cast("bigint").alias("_cycle"),
        (F.col("_floor") + 1 + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0))
        .cast("bigint").alias("_units"))


def cycle_slots(units: DataFrame) -> DataFrame:
    """Slots of one cycle: ``_source``, ``_units``, ``_cycle``, ``_nth`` (block in the cycle), ``_slot``.

    One fold over the slots of a cycle. Its size is that of the cycle: at least ten slots per
    source, whatever the number of rows.
    """
    listed = units.agg(F.sort_array(F.collect_list(F.struct("_source", "_units"))).alias("s"),
                       F.max("_cycle").alias("c")).filter("c IS NOT NULL")

    def step(state: Column, t: Column) -> Column:
        def waiting(s: Column, i: Column) -> Column:
            k = F.get(state["done"], i)
            due = F.ceil((k + 1) * F.col("c") / s["_units"])
            released = F.floor(k * F.col("c") / s["_units"]) <= t
            return F.when(released & (k < s["_units"]), F.struct(due.alias("due"), i.alias("i")))

        ready = F.filter(F.transform(F.col("s"), waiting), lambda x: x.isNotNull())
        return let(F.array_min(ready)["i"], lambda pick: F.struct(
            F.transform(state["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d)).alias("done"),
            F.concat(state["runs"], F.array(F.struct(
                pick.alias("i"), F.get(state["done"], pick).alias("k")))).alias("runs")))

    start = F.struct(
        F.transform(F.col("s"), lambda _: F.lit(0).cast("bigint")).alias("done"),
        F.array().cast("array<struct<i:int,k:bigint>>").alias("runs"))
    runs = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1), start, step)["runs"]
    flat = listed.select("s", "c", F.posexplode(runs).alias("slot", "run"))
    return flat.select(
        F.get("s", F.col("run.i"))["_source"].alias("_source"),
        F.get("s", F.col("run.i"))["_units"].alias("_units"), F.col("c").alias("_cycle"),
        F.col("run.k").alias("_nth"), F.col("slot").cast("bigint").alias("_slot"))


def mix_sources(rows: DataFrame, source: str = "source", key: str = "doc_id",
                weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS,
                cycle: int = CYCLE) -> DataFrame:
    """Every row with its place in the mix, in columns ``source_rank``, ``block``, ``slot``, ``mix_order``.

    Rows of a source are ranked by the MD5 of their key and cut into blocks of ``block_rows``; a
    block's slot is its scheduled slot, and ``mix_order`` sorts all rows into the mix. When a
    source has no blocks left its slots stay empty and the others go on in their order.

    No row is lost: a null source is a source of its own, a source without a weight gets one slot
    per cycle, a null key ranks as the text ``null``; repeated rows get ranks of their own. Rows
    with one key are ranked by a hash of all their columns. An empty table gives an empty mix;
    result columns replace input columns of the same name. Ranking splits each source over 4,096
    ranges of the MD5, so a source with a third of all rows is shared by as many tasks.
    """
    names = ("source_rank", "block", "slot", "mix_order")
    # The whole row travels in one struct, so its column names cannot clash with the ones here.
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        _key(F.col(source)).alias("s"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")).alias("md"),
    ).withColumn("p", F.substring("md", 1, 3))
    sizes = packed.groupBy("s", "p").agg(F.count("*").alias("n"))
    before = W.partitionBy("s").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("s", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("s", "p").orderBy("md", F.xxhash64(F.to_json("row")))
    ranked = packed.withColumn("inside", F.row_number().over(inside)).join(starts, ["s", "p"]).select(
        "row", "s", (F.col("start") + F.col("inside") - 1).alias("source_rank")
    ).withColumn("block", F.floor(F.col("source_rank") / block_rows).cast("bigint"))
    # One row per source, holding its slots of a cycle: bounded by the cycle's length.
    per_source = cycle_slots(source_units(rows, source, weights, cycle)).groupBy(
        F.col("_source").alias("s")).agg(
        F.first("_units").alias("u"), F.first("_cycle").alias("c"),
        F.sort_array(F.collect_list("_slot")).alias("slots"))
    k, u = F.col("block"), F.col("u")
    placed = ranked.join(F.broadcast(per_source), "s").withColumn(
        "slot", F.floor(k / u).cast("bigint") * F.col("c") + F.get("slots", (k % u).cast("int"))
    ).withColumn("mix_order", F.col("slot") * block_rows + F.col("source_rank") % block_rows)
    kept = [F.col(f"row.`{c}`") for c in rows.columns if c not in names]
    return placed.select(*kept, *names)
