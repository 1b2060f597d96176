"""Evaluation tables from (actual, predicted) pairs, as plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTUAL, PREDICTED = "actual", "predicted"


def pair_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(ACTUAL, PREDICTED).agg(F.count(F.lit(1)).alias("n"))


def confusion_cells(predictions: DataFrame) -> DataFrame:
    """One row per pair of labels, zero included.

    ``predictions`` shrinks to one row per pair of classes in its first aggregate; everything
    after that works on that handful of rows.
    """
    counts = pair_counts(predictions)
    labels = counts.agg(F.array_sort(F.array_distinct(F.concat(
        F.collect_set(ACTUAL), F.collect_set(PREDICTED)))).alias("labels"))
    cells = labels.select(F.explode("labels").alias(ACTUAL), "labels").select(
        ACTUAL, F.explode("labels").alias(PREDICTED))
    return cells.join(counts, [ACTUAL, PREDICTED], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def confusion_matrix(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per actual label, one column per predicted label."""
    counters = [F.sum(F.when(F.col(PREDICTED) == label, F.col("n")).otherwise(0)).alias(label)
                for label in labels]
    rows = predictions.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(label) for label in labels])).alias(ACTUAL))
    return rows.join(pair_counts(predictions), ACTUAL, "left").groupBy(ACTUAL).agg(*counters)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages."""
    n, hit = F.col("n"), F.col(ACTUAL) == F.col(PREDICTED)
    per_side = confusion_cells(predictions).select(F.inline(F.array(
        F.struct(F.col(ACTUAL).alias("label"), n.alias("support"), F.lit(0).cast("bigint")
                 .alias("predicted_n"), F.when(hit, n).otherwise(0).alias("hits")),
        F.struct(F.col(PREDICTED).alias("label"), F.lit(0).cast("bigint").alias("support"),
                 n.alias("predicted_n"), F.lit(0).cast("bigint").alias("hits")),
    ))).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted_n", "hits")])
    precision = _ratio(F.col("hits"), F.col("predicted_n"))
    recall = _ratio(F.col("hits"), F.col("support"))
    classes = per_side.select(
        "label", precision.alias("precision"), recall.alias("recall"), "support", "hits"
    ).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                              F.col("precision") + F.col("recall")))
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = F.sum("hits") / total
    averages = classes.agg(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(s) for s in scores],
                 total.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(s).alias(s) for s in scores],
                 total.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"),
                 *[_ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
                 total.alias("support")),
    ).alias("rows")).select(F.inline("rows"))
    return classes.select("label", *scores, "support").unionByName(averages)


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col(ACTUAL) == F.col(PREDICTED)).cast("double")).alias("accuracy"))
