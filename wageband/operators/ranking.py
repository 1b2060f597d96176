"""First rows per group and dense row numbers without putting a hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Hash buckets a group is spread over before its candidates meet in one task.
SALTS = 256
# Positions per block when numbering rows: the most rows one task numbers for one block.
BLOCK = 1 << 16


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key, nulls forming one key of their own.

    The filter on ``row_number`` makes Spark keep one row per key and map task before the
    shuffle, so copies of a hot key are dropped where they are read.
    """
    first = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int,
                rank: str = "_rank") -> DataFrame:
    """Rows ranked 1..n per group by ``order``, with the rank.

    Few groups would leave most of the cluster idle. So each group is first cut to n rows per
    salt, in as many tasks as there are salts, and the final ranking sees n * salts rows per group
    at most.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    near = W.partitionBy(*groups, "_salt").orderBy(*order)
    final = W.partitionBy(*groups).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(near)).filter(F.col(rank) <= n)
        .drop("_salt", rank)
        .withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)
    )


def with_row_id(df: DataFrame, position: str, groups: Sequence[str] = (),
                name: str = "source_id", block: int = BLOCK,
                counted: DataFrame | None = None) -> DataFrame:
    """Dense 1-based row number in the order of ``groups`` then ``position``, nulls first.

    Rows are numbered inside blocks of the position, each at most ``block`` rows long, and the
    blocks get running offsets from their counts. Only the block counts, one row per ``block``
    positions of a dense position, are summed in a single task. ``position`` is a whole number,
    unique per group; a null group or position is numbered like any other. ``counted`` has the same
    positions and groups as ``df``, and is cheaper to read: blocks are then counted on it.
    """
    keys = [*groups, "_block"]
    number = F.floor(F.col(position) / F.lit(block)).cast("bigint")
    blocked = df.withColumn("_block", number)
    rows = (df if counted is None else counted).select(*groups, number.alias("_block"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_at_{k}") for k in keys],
                           F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys).orderBy(position)
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    return (
        blocked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, reduce(lambda a, b: a & b, same))
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_block", "_inside", "_start", *[f"_at_{k}" for k in keys])
    )


def with_file_row_id(scan: DataFrame, name: str = "source_id") -> DataFrame:
    """Dense 1-based row number in the order of file path, then row within the file.

    For a table read straight from Parquet files.
    """
    located = scan.withColumns({
        "_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return with_row_id(located, "_row", ["_file"], name).drop("_file", "_row")
