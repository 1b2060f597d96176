"""Unions of posting tables under named keep policies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.operators import dedup

PIECE = "piece_no"
POSITION = "pos"
ORDER = [PIECE, POSITION]


def union_pieces(pieces: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, missing columns null, pieces numbered in the given order."""
    numbered = [p.withColumn(PIECE, F.lit(i)) for i, p in enumerate(pieces)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def merge(pieces: Sequence[DataFrame], keep: str, drop_null_keys: bool = True) -> DataFrame:
    return dedup.deduplicate(union_pieces(pieces), ORDER, keep, drop_null_keys=drop_null_keys)


def merge_session(old: DataFrame, checkpoint: DataFrame, session: DataFrame) -> DataFrame:
    """Stored batch, then checkpoint, then this session: the newest row per URL stays."""
    return merge([old, checkpoint, session], "last")


def merge_latest_wins(combined: DataFrame, batches: Sequence[DataFrame]) -> DataFrame:
    """Old combined table, then the batches by name: the latest batch wins."""
    return merge([combined, *batches], "last")


def merge_batch_table(combined: DataFrame | None, batches: DataFrame,
                      batch: str = "batch_name") -> DataFrame:
    """The same with all batches in one table: one union however many batches there are."""
    pieces = union_pieces([batches] if combined is None else [combined, batches])
    if combined is None:
        return dedup.keep_last(pieces, [batch, POSITION])
    return dedup.keep_last(pieces, [PIECE, batch, POSITION])


def merge_first_wins(batches: DataFrame, provenance: str = "source_batch_file") -> DataFrame:
    """Batch rows with their file name: the earliest file wins, rows without a key kept as one."""
    return dedup.keep_first_by_cascade(batches, [provenance, POSITION])


def merge_existing_wins(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Fold a batch into a table: rows already there stay as they are."""
    return merge([existing, added], "first")


def merge_low_batch(old: DataFrame, checkpoint: DataFrame) -> DataFrame:
    return merge([old, checkpoint], "last")


def merge_counts(before: DataFrame, after: DataFrame, source: str) -> DataFrame:
    """Per source: rows before and after a merge, and rows removed."""
    n = F.count(F.lit(1))
    left = after.groupBy(F.col(source).alias("_source")).agg(n.alias("rows_after"))
    return (
        before.groupBy(source).agg(n.alias("rows_before"))
        .join(left, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")
        .withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
        .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    )
