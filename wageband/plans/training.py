"""Wage-band classification with MLlib."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wageband.operators.report import distribution
from wageband.plans.datasets import labelled_rows
from wageband.plans.metrics import (
    ACTUAL, PREDICTED, classification_report, confusion_matrix,
)
from wageband.schemas import CATEGORY_COLUMNS, FLAG_COLUMNS, TARGET_COLUMN
from wageband.session import stored_rows

# Forest size, leaf size, seed, hold-out share and smallest table to train on.
TREES, LEAF, SEED, TEST_SHARE, SMALLEST = 300, 2, 42, 0.2, 20
# The deepest tree that MLlib grows.
DEPTH = 30
# MLlib takes its split points from a sample of more rows than SAMPLED or the square of its bins, which
# has to fit 32 bits.
BINS, MOST_BINS, SAMPLED = 32, 46_340, 10_000
# Hash ranges per class, named by hex digits, in which the split looks for its cutting point.
BUCKET_DIGITS = 4
# Shares between which the middle of a column must lie, and the accuracy they are estimated with.
AROUND_MIDDLE, ACCURACY = (0.4995, 0.5005), 10_000


class NotTrainable(ValueError):
    """The table cannot be used for training; the message says why."""


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and text features, from the fixed feature list and the table's types."""
    types = dict(df.dtypes)
    present = [c for c in FLAG_COLUMNS + CATEGORY_COLUMNS if c in types]
    text = [c for c in present if types[c] == "string"]
    return [c for c in present if c not in text], text


def check_columns(df: DataFrame, features: Sequence[str]) -> None:
    if TARGET_COLUMN not in df.columns:
        raise NotTrainable(f"the table has no column {TARGET_COLUMN!r}")
    if not features:
        raise NotTrainable("the table has no feature column")


def check_rows(labelled: DataFrame) -> None:
    size = labelled.agg(F.count(F.lit(1)).alias("n"),
                                 F.count_distinct(TARGET_COLUMN).alias("classes")).first()
    if size["n"] < SMALLEST:
        raise NotTrainable(f"{size['n']} labelled rows, at least {SMALLEST} are needed")
    if size["classes"] < 2:
        raise NotTrainable("at least two classes are needed")


def _class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(TARGET_COLUMN).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    everything = W.partitionBy()
    return _class_counts(df).withColumn("weight", F.sum("n").over(everything)
                             / (F.count(F.lit(1)).over(everything) * F.col("n")))


def _shared_out(counts: DataFrame, share: float) -> DataFrame:
    """Exact part sizes from the rows per class."""
    everything = W.partitionBy()
    sized = counts.withColumns({
        "rows": F.sum("n").over(everything),
        "_classes": F.count(F.lit(1)).over(everything),
        "_smallest": F.min("n").over(everything),
    }).withColumns({
        "test_total": F.ceil(F.col("rows") * F.lit(share)),
        "stratified": (F.col("_smallest") >= 2) & (F.col("rows") >= 5 * F.col("_classes")),
    }).withColumn("_train", F.col("rows") - F.col("test_total"))
    by_rest = W.orderBy(F.desc("_rest"), F.asc(TARGET_COLUMN))
    shared = sized.withColumns({
        "_floor": F.expr("(_train * n) div rows"), "_rest": F.expr("(_train * n) % rows"),
    }).withColumns({
        "_left": F.col("_train") - F.sum("_floor").over(everything),
        "_place": F.row_number().over(by_rest),
    })
    train = F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("int")
    return shared.withColumn("n_train", F.when(F.col("stratified"), train)).select(
        TARGET_COLUMN, "n", "n_train", (F.col("n") - F.col("n_train")).alias("n_test"),
        "stratified", "test_total")


def split_sizes(df: DataFrame, share: float = TEST_SHARE) -> DataFrame:
    """Rows per class with the exact size of its training and test part.

    Stratified when every class has two rows and there are five rows per class on average. The
    training total is shared out by largest remainder, ties by label.
    """
    return _shared_out(_class_counts(df), share)


def with_split(df: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_test`` with exact test sizes per class, decided by a hash of the unique ``key``.

    Hash ranges are counted per class, which tells in which range a class reaches its test size.
    Only the rows of that range, a tiny part of the class, are ranked; the last one taken is the
    class's threshold. All rows are then marked by comparing with a broadcast row per class, so
    the table itself is neither shuffled nor sorted.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.col(key).cast("string"),
                                                      F.lit(str(seed)))))
    narrow = hashed.select(key, TARGET_COLUMN, "_hash", F.conv(
        F.substring("_hash", 1, BUCKET_DIGITS), 16, 10).cast("int").alias("_bucket"))
    # Three steps read the counts, one row per class and range: write them once.
    sizes = stored_rows(narrow.groupBy(TARGET_COLUMN, "_bucket").agg(
        F.count(F.lit(1)).alias("_size")), "split-sizes")
    wanted = _shared_out(sizes.groupBy(TARGET_COLUMN).agg(F.sum("_size").alias("n")), share)
    # Without stratification all classes form one group.
    group = F.when(F.col("stratified"), F.col(TARGET_COLUMN)).otherwise("").alias("_group")
    want = F.when(F.col("stratified"), F.col("n_test")).otherwise(F.col("test_total"))
    groups = F.broadcast(wanted.select(TARGET_COLUMN, group, want.alias("_want")))

    up_to = W.partitionBy("_group").orderBy("_bucket")
    start = F.col("_end") - F.col("_size")
    cuts = (
        sizes.join(groups, TARGET_COLUMN).groupBy("_group", "_bucket")
        .agg(F.sum("_size").alias("_size"), F.first("_want").alias("_want"))
        .withColumn("_end", F.sum("_size").over(up_to))
        .filter((F.col("_want") > start) & (F.col("_want") <= F.col("_end")))
        .select("_group", "_bucket", (F.col("_want") - start).alias("_open"))
    )
    point = F.struct(F.col("_hash"), F.col(key))
    ranked = (
        narrow.join(groups, TARGET_COLUMN).join(F.broadcast(cuts), ["_group", "_bucket"])
        .withColumn("_place", F.row_number().over(W.partitionBy("_group").orderBy("_hash", key)))
        .filter(F.col("_place") == F.col("_open"))
        .select("_group", point.alias("_last"))
    )
    limits = wanted.select(TARGET_COLUMN, group).join(ranked, "_group", "left").select(
        TARGET_COLUMN, "_last")
    # No threshold means that the group gives no test row.
    return hashed.join(F.broadcast(limits), TARGET_COLUMN).withColumn(
        "is_test", F.coalesce(point <= F.col("_last"), F.lit(False))).drop("_hash", "_last")


def impute_values(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row: exact median per numeric column, most frequent value (then smallest) per text.

    The steps read the rows four times: these columns are written once, so that ``df`` is worked out once.
    """
    return _stored_values(stored_rows(df.select(*numeric, *text), "impute"), numeric, text)


def _stored_values(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    parts = []
    if numeric:
        parts.append(_medians(df.select(*[F.col(c).cast("double").alias(c) for c in numeric])))
    if text:
        values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in text])
        counts = df.select(F.inline(values)).filter("text IS NOT NULL").groupBy("column", "text").agg(
            F.count(F.lit(1)).alias("n"))
        parts.append(counts.groupBy("column").agg(
            F.min(F.struct(-F.col("n"), "text"))["text"].alias("text")).select(
            "column", F.lit(None).cast("double").alias("number"), "text"))
    found = reduce(DataFrame.unionByName, parts)
    return found.agg(
        *[F.max(F.when(F.col("column") == c, F.col("number"))).alias(c) for c in numeric],
        *[F.max(F.when(F.col("column") == c, F.col("text"))).alias(c) for c in text])


def _medians(df: DataFrame) -> DataFrame:
    """Exact median of every column, one row each.

    Approximate quantiles, whose error has a bound, give a narrow range around the middle. Rows
    below it are only counted; the distinct values inside, about a thousandth of a continuous
    column, are ranked per column. The numbers that come to the driver are per column.
    """
    columns = df.columns
    first = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(c, list(AROUND_MIDDLE), ACCURACY).alias(f"q{i}")
          for i, c in enumerate(columns)]).first()
    known = [i for i in range(len(columns)) if first[f"n{i}"]]
    ranges = {i: first[f"q{i}"] for i in known}
    if not known:
        return df.sparkSession.createDataFrame([], "column STRING, number DOUBLE, text STRING")
    below = df.agg(*[F.count_if(F.col(columns[i]) < ranges[i][0]).alias(f"b{i}") for i in known]).first()
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(columns[i]).alias("v"),
                               F.lit(ranges[i][0]).alias("low"), F.lit(ranges[i][1]).alias("high"))
                      for i in known])
    inside = df.select(F.inline(F.filter(
        cells, lambda x: (x["v"] >= x["low"]) & (x["v"] <= x["high"])))).groupBy("i", "v").agg(
        F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("i").orderBy("v")
    places = df.sparkSession.createDataFrame(
        [(i, columns[i], (first[f"n{i}"] - 1) // 2, first[f"n{i}"] // 2, below[f"b{i}"]) for i in known],
        "i INT, column STRING, lower BIGINT, upper BIGINT, before BIGINT")
    ranked = inside.withColumn("end", F.sum("n").over(upto)).join(F.broadcast(places), "i").withColumns({
        "end": F.col("end") + F.col("before"), "start": F.col("end") + F.col("before") - F.col("n")})
    holds = lambda place: (F.col("start") <= F.col(place)) & (F.col(place) < F.col("end"))
    return ranked.groupBy("column").agg(
        ((F.max(F.when(holds("lower"), F.col("v"))) + F.max(F.when(holds("upper"), F.col("v")))) / 2)
        .alias("number"), F.lit(None).cast("string").alias("text"))


@dataclass
class Training:
    """A fitted forest and its evaluation on the held-out part."""

    model: PipelineModel
    fills: dict[str, object]
    predictions: DataFrame
    metrics: DataFrame
    report: DataFrame
    confusion: DataFrame
    importance: DataFrame
    targets: DataFrame
    labels: list[str] = field(default_factory=list)

    def save(self, root: str) -> None:
        self.model.write().overwrite().save(f"{root}/model")
        for name in ("metrics", "report", "confusion", "importance", "targets"):
            getattr(self, name).write.mode("overwrite").parquet(f"{root}/{name}")


def bins(rows: int) -> int:
    """Bins that let the split points come from all ``rows``; a column uses no more than it has values."""
    return BINS if rows <= SAMPLED else min(math.isqrt(rows - 1) + 1, MOST_BINS)


def _stages(numeric: Sequence[str], text: Sequence[str], labels: list[str], trees: int,
            depth: int, seed: int, rows: int) -> list:
    indexed = [f"_i_{c}" for c in text]
    coded = [f"_o_{c}" for c in text]
    stages: list = []
    if text:
        # The slot kept for unseen values is the one that the encoder drops: they become zeros.
        stages += [
            StringIndexer(inputCols=list(text), outputCols=indexed,
                          stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
        ]
    return stages + [
        VectorAssembler(inputCols=[*numeric, *coded], outputCol="features"),
        RandomForestClassifier(
            labelCol="_label", featuresCol="features", weightCol="_weight",
            predictionCol="_predicted", numTrees=trees, maxDepth=depth, seed=seed,
            minInstancesPerNode=LEAF, featureSubsetStrategy="sqrt", impurity="gini", maxBins=bins(rows),
            # More tree nodes per pass over the rows.
            maxMemoryInMB=1024),
        IndexToString(inputCol="_predicted", outputCol=PREDICTED, labels=labels),
    ]


def _importance(model: PipelineModel, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    names = [f"num__{c}" for c in numeric]
    if text:
        for column, values in zip(text, model.stages[0].labelsArray):
            names += [f"cat__{column}_{v}" for v in values]
    weights = model.stages[-2].featureImportances.toArray().tolist()
    rows = SparkSession.active().createDataFrame(
        list(zip(names, weights)), "feature STRING, importance DOUBLE")
    return rows.orderBy(F.desc("importance"), "feature")


def train(df: DataFrame, key: str = "source_id", trees: int = TREES, depth: int = DEPTH,
          share: float = TEST_SHARE, seed: int = SEED, numeric: Sequence[str] | None = None,
          text: Sequence[str] | None = None, fit_rows: int | None = None) -> Training:
    """Split, impute, encode, fit and evaluate.

    ``fit_rows`` bounds the rows that the forest is fitted on: the first of the training part by
    the MD5 of their key. Split, fills and evaluation cover all rows in any case.
    ``numeric`` and ``text`` replace the posting features. The tables that reach the driver are
    per class or per feature, never per row.
    """
    if numeric is None and text is None:
        numeric, text = feature_columns(df)
    numeric, text = list(numeric or []), list(text or [])
    check_columns(df, numeric + text)
    # Every step below reads the rows again: keep the narrow ones instead of parsing texts anew.
    rows = labelled_rows(df).select(key, *numeric, *text, TARGET_COLUMN).persist()
    check_rows(rows)
    split = stored_rows(with_split(rows, key, share, seed), "split")
    n_rows = split.count()
    rows.unpersist()
    fitting = split.filter(~F.col("is_test"))
    stats = _stored_values(fitting, numeric, text).first().asDict()
    # A column without any value has no median; it is filled with zeros, which no tree can split.
    fills = {**{c: 0.0 for c in numeric}, **{c: v for c, v in stats.items() if v is not None}}
    if fit_rows is not None:
        fitting = fitting.orderBy(F.md5(F.col(key).cast("string")), key).limit(fit_rows)

    labels = [r[0] for r in split.select(TARGET_COLUMN).distinct().orderBy(TARGET_COLUMN).collect()]
    place = F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, float(i))])
    weights = class_weights(fitting).select(TARGET_COLUMN, F.col("weight").alias("_weight"))

    def prepared(part: DataFrame) -> DataFrame:
        numbers = part.withColumns({c: F.col(c).cast("double") for c in numeric})
        return numbers.fillna(fills).withColumn("_label", place[F.col(TARGET_COLUMN)])

    most = n_rows if fit_rows is None else min(n_rows, fit_rows)
    model = Pipeline(stages=_stages(numeric, text, labels, trees, depth, seed, most)).fit(
        prepared(fitting).join(F.broadcast(weights), TARGET_COLUMN))
    predictions = model.transform(prepared(split.filter("is_test"))).select(
        key, F.col(TARGET_COLUMN).alias(ACTUAL), PREDICTED)
    test_rows = F.count(F.lit(1))
    metrics = predictions.agg(
        F.lit(n_rows).alias("n_rows"), (F.lit(n_rows) - test_rows).alias("n_train"),
        test_rows.alias("n_test"),
        F.avg((F.col(ACTUAL) == F.col(PREDICTED)).cast("double")).alias("accuracy"),
    ).withColumns({
        "n_classes": F.lit(len(labels)),
        "numeric_features": F.array(*[F.lit(c) for c in numeric]),
        "text_features": F.array(*[F.lit(c) for c in text])})
    return Training(
        model, fills, predictions, metrics, classification_report(predictions),
        confusion_matrix(predictions, labels), _importance(model, numeric, text),
        distribution(split), labels)

