import math
import re

import pytest
from pyspark.sql import functions as F

from wageband.plans import metrics, training
from wageband.schemas import BAND_LABELS, TARGET_COLUMN, TRAINING_SCHEMA
from workload.queries import QUERIES


def _labels(spark, counts):
    rows, i = [], 0
    for label, n in counts.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, f"key BIGINT, {TARGET_COLUMN} STRING")


@pytest.mark.parametrize("counts, stratified", [
    ({c: 5 for c in "abcde"}, True), ({"a": 5, "b": 5, "c": 5, "d": 5, "e": 4}, False),
    ({"a": 100, "b": 33, "c": 7}, True), ({"a": 30, "b": 1}, False), ({"a": 3000, "b": 9, "c": 2}, True),
])
def test_split_is_exact(spark, counts, stratified):
    rows = _labels(spark, counts)
    total = sum(counts.values())
    sizes = training.split_sizes(rows).collect()
    assert {r.stratified for r in sizes} == {stratified}
    marked = training.with_split(rows, "key")
    assert marked.count() == total
    got = {r[0]: r[1] for r in marked.filter("is_test").groupBy(TARGET_COLUMN).count().collect()}
    assert sum(got.values()) == math.ceil(0.2 * total)
    if stratified:
        assert {r[TARGET_COLUMN]: r.n_test for r in sizes if r.n_test} == got
        assert all(abs(r.n_test - 0.2 * r.n) <= 1 for r in sizes)
    again = training.with_split(rows.repartition(3), "key")
    assert marked.exceptAll(again).count() == 0


def test_metrics_fixture(spark):
    pairs = spark.createDataFrame(list(zip("aabc", "abbb")), "actual STRING, predicted STRING")
    rows = {r.label: r for r in metrics.classification_report(pairs).collect()}
    assert [rows[c].precision for c in "abc"] == [1, pytest.approx(1 / 3), 0]
    assert [rows[c].recall for c in "abc"] == [0.5, 1, 0]
    assert [rows[c].f1 for c in "abc"] == [pytest.approx(2 / 3), 0.5, 0]
    assert [rows[c].support for c in "abc"] == [2, 1, 1]
    assert rows["accuracy"].f1 == 0.5 and rows["macro avg"].f1 == pytest.approx(7 / 18)
    assert rows["weighted avg"].precision == pytest.approx(7 / 12)
    assert rows["weighted avg"].f1 == pytest.approx(11 / 24)
    matrix = {r.actual: (r.a, r.b, r.c) for r in metrics.confusion_matrix(pairs, "abc").collect()}
    assert matrix == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 1, 0)}
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion_cells(pairs).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4
    weights = pairs.withColumnRenamed("actual", TARGET_COLUMN)
    assert {r[0]: r.weight for r in training.class_weights(weights).collect()} == {
        "a": pytest.approx(2 / 3), "b": pytest.approx(4 / 3), "c": pytest.approx(4 / 3)}


def test_impute(spark):
    rows = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (10.0, "a"), (None, "b"), (None, None)],
                                 "x DOUBLE, c STRING")
    assert tuple(training.impute_values(rows, ["x"], ["c"]).first()) == (2.0, "a")
    assert training.impute_values(rows.limit(2), ["x"], []).first().x == 1.5


def test_impute_works_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(10).selectExpr("cast(id AS DOUBLE) AS x", "cast(id % 2 AS STRING) AS c").mapInPandas(
        count, "x DOUBLE, c STRING")
    assert tuple(training.impute_values(rows, ["x"], ["c"]).first()) == (4.5, "0")
    assert seen.value == 10


def _training_rows(spark, n):
    bands = [F.when(F.col("id") % 2 == 0, BAND_LABELS[2]).otherwise(BAND_LABELS[4])]
    columns = []
    for f in TRAINING_SCHEMA.fields:
        value = {"source_id": F.col("id"), "f_major_it": (F.col("id") % 2).cast("int"),
                 "f_min_gpa": F.when(F.col("id") % 3 != 0, 3.0),
                 "job_family": F.when(F.col("id") % 5 == 0, "data").otherwise("other"),
                 "region_group": F.when(F.col("id") == 0, "rare").otherwise("jawa barat"),
                 TARGET_COLUMN: bands[0]}.get(f.name, F.lit(None))
        columns.append(F.coalesce(value, F.lit(0)).cast(f.dataType).alias(f.name)
                       if f.name.startswith("f_") and f.name != "f_min_gpa"
                       else value.cast(f.dataType).alias(f.name))
    return spark.range(n).select(*columns)


def test_train(spark, tmp_path):
    rows = _training_rows(spark, 100).withColumn("source_batch_file", F.lit("leak"))
    fitted = training.train(rows, trees=10, depth=5)
    one = fitted.metrics.first()
    assert (one.n_rows, one.n_train, one.n_test, one.n_classes) == (100, 80, 20, 2)
    assert one.accuracy > 0.9 and "source_batch_file" not in one.text_features
    top = fitted.importance.first()
    assert top.feature == "num__f_major_it"
    names = {r.feature for r in fitted.importance.collect()}
    assert {"cat__job_family_data", "cat__job_family_other"} <= names
    assert sum(sum(r[1:]) for r in fitted.confusion.collect()) == 20
    fitted.save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    loaded = PipelineModel.load(str(tmp_path / "m" / "model"))
    # A category that training never saw becomes all zeros instead of an error.
    unseen = rows.limit(5).fillna(fitted.fills).withColumn("job_family", F.lit("new")).withColumns(
        {c: F.col(c).cast("double") for c in one.numeric_features})
    assert loaded.transform(unseen).select("predicted").count() == 5
    encoded = loaded.transform(unseen).first()["_o_job_family"]
    assert encoded.numNonzeros() == 0 and encoded.size == 2


@pytest.mark.parametrize("n, drop, message", [
    (19, [], "at least 20"), (30, [TARGET_COLUMN], "no column"),
])
def test_guards(spark, n, drop, message):
    with pytest.raises(training.NotTrainable, match=message):
        training.train(_training_rows(spark, n).drop(*drop))


def test_one_class_and_no_features(spark):
    rows = _training_rows(spark, 30)
    with pytest.raises(training.NotTrainable, match="two classes"):
        training.train(rows.withColumn(TARGET_COLUMN, F.lit("x")))
    with pytest.raises(training.NotTrainable, match="no feature"):
        training.train(rows.select("source_id", TARGET_COLUMN))


def _orders(spark, folder, n):
    """Orders and customers from which the queries derive ``n`` postings."""
    spark.range(1, n + 1).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "cast(pmod(hash(id), 400000) AS DOUBLE) AS o_totalprice",
        "timestamp'2020-01-01 00:00:00' AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.range(7).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(
        f"{folder}/customer.parquet")


def test_metrics_query_fits_every_training_row(spark, tmp_path, monkeypatch):
    _orders(spark, tmp_path, 4_000)
    fitted, fit, train = [], training.Pipeline.fit, training.train
    monkeypatch.setattr(training.Pipeline, "fit", lambda self, rows: fitted.append(rows.count()) or fit(self, rows))
    monkeypatch.setattr(training, "train", lambda *args, **given: train(*args, **{**given, "trees": 2, "depth": 2}))
    one = QUERIES["rf_train_metrics"](spark, str(tmp_path)).first()
    assert one.n_train > 2_000 and fitted == [one.n_train]


def test_split_points_come_from_all_rows(spark):
    """A dozen values of few rows among many others; their class changes from one to the next."""
    x = F.when(F.col("id") < 96, F.col("id") % 12 + 1).otherwise(0).cast("double")
    rows = spark.range(150_000).select(F.col("id").alias("source_id"), x.alias("x"), F.when(
        x % 2 == 1, "b").otherwise("a").alias(TARGET_COLUMN))
    fitted = training.train(rows, trees=10, numeric=["x"], text=[])
    assert fitted.metrics.first().accuracy == 1
    splits = {float(v) for t in fitted.model.stages[-2].trees for v in re.findall(
        r"feature 0 <= ([0-9.]+)", t.toDebugString)}
    assert len(splits) >= 11


@pytest.mark.parametrize("rows", [10_001, 88_576, 90_000, 90_001, 5_400_000])
def test_bins_cover_the_rows(rows):
    assert training.bins(rows) ** 2 >= rows > (training.bins(rows) - 1) ** 2
    assert training.bins(10_000) == 32 and training.bins(10**12) ** 2 < 2**31
