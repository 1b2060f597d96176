"""Connected components of an edge table by alternating stars, without gathering a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.llm.common import stored

MOST_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        joined.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``id`` and ``component`` (least id of its component) of every id in an edge table (u, v).

    Both columns are BIGINT; edges may repeat, point either way or loop, and nulls are left out.
    Ids without an edge to another id do not appear: each is its own component. Every round is
    written to the shared folder; only two sums per round come to the driver. A node's neighbours
    meet only in aggregations that combine before the shuffle.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        "u > v").distinct(), purpose)
    mark = None
    for _ in range(MOST_ROUNDS):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row[0] == 0 or tuple(row) == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()).distinct()
        mark = tuple(row)
        now = stored(_small_star(_large_star(now)), purpose)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
