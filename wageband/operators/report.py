"""Counts and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.functions.features import with_repaired_region
from wageband.schemas import BAND_LABELS, TARGET_COLUMN, TARGET_PER_CLASS


def distribution(df: DataFrame, column: str = TARGET_COLUMN) -> DataFrame:
    """Rows per value, most frequent first; null is not a value."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    )


def class_counts(df: DataFrame, labels: Sequence[str] = BAND_LABELS,
                 cap: int | None = None) -> DataFrame:
    """Rows of every listed class, zero included.

    One counter per class in a single global aggregate: map tasks send one row each, and no
    class of any size gathers in a task.
    """
    counters = [F.struct(F.lit(label).alias(TARGET_COLUMN),
                         F.count_if(F.col(TARGET_COLUMN) == label).alias("n")) for label in labels]
    counts = df.agg(F.array(*counters).alias("c")).select(F.inline("c"))
    return counts if cap is None else counts.withColumn("n", F.least("n", F.lit(cap)))


def class_deficits(counts: DataFrame, target: int = TARGET_PER_CLASS) -> DataFrame:
    return counts.withColumn("deficit", F.greatest(F.lit(target) - F.col("n"), F.lit(0)))


def targets_done(counts: DataFrame, target: int = TARGET_PER_CLASS) -> DataFrame:
    return counts.agg(F.bool_and(F.col("n") >= target).alias("done"))


def region_repair_diff(df: DataFrame) -> DataFrame:
    """Rows per region as stored and as repaired, in one pass over the table."""
    sides = F.array(
        F.struct(F.col("region_group").alias("region"), F.lit(1).alias("before"),
                 F.lit(0).alias("after")),
        F.struct(F.col("_repaired").alias("region"), F.lit(0).alias("before"),
                 F.lit(1).alias("after")),
    )
    return with_repaired_region(df, "_repaired").select(F.inline(sides)).groupBy("region").agg(
        F.sum("before").alias("n_before"), F.sum("after").alias("n_after"))
