import random

import pytest
from pyspark.sql import functions as F

from wageband.operators import merge
from wageband.sources.buckets import BUCKET, BucketedTable
from wageband.sources.tables import Manifests

LAYOUT = "pos BIGINT, job_url STRING, job_title STRING"


def _rows(df):
    return sorted(map(tuple, df.select("pos", "job_url", "job_title").collect()))


@pytest.mark.parametrize("keep", ["first", "last"])
def test_merges_one_by_one_equal_one_merge(spark, tmp_path, keep):
    rng = random.Random(2)
    pieces = [spark.createDataFrame(
        [(i, rng.choice([None, "", *[f"u{j}" for j in range(60)]]), f"{p}-{i}") for i in range(50)], LAYOUT)
        for p in range(4)]
    table = BucketedTable(str(tmp_path), buckets=8)
    for piece in pieces:
        table.merge(piece, keep)
    expected = merge.merge(pieces, keep)
    assert _rows(table.read(spark)) == _rows(expected)
    # Earlier states stay as they were.
    assert _rows(table.read(spark, 2)) == _rows(merge.merge(pieces[:2], keep))


def test_a_small_merge_reads_and_writes_a_small_share(spark, tmp_path):
    table = BucketedTable(str(tmp_path), buckets=64)
    first = table.merge(spark.range(3000).selectExpr("id AS pos", "concat('u', id) AS job_url", "'old' AS job_title"))
    assert len(first.folders) == 64
    few = spark.createDataFrame([(i, f"u{i * 100}", "new") for i in range(3)], LAYOUT)
    touched = {str(r[0]) for r in few.select(table.bucket_of(F.col("job_url"))).collect()}
    second = table.merge(few)
    assert {b for b in second.folders if second.folders[b] != first.folders[b]} == touched and len(touched) <= 3
    found = table.read(spark)
    assert found.count() == 3000 and found.filter("job_title = 'new'").count() == 3
    assert BUCKET not in found.columns


def test_a_merge_on_top_of_another_loses_nothing(spark, tmp_path, monkeypatch):
    table = BucketedTable(str(tmp_path), buckets=4)

    def rows(start, title):
        return spark.createDataFrame([(i, f"u{i}", title) for i in range(start, start + 20)], LAYOUT)

    table.merge(rows(0, "a"))
    publish, calls = Manifests.publish, []

    def overtaken(self, session, number, folders):
        calls.append(number)
        if len(calls) == 1:
            table.merge(rows(10, "b"))
        return publish(self, session, number, folders)

    monkeypatch.setattr(Manifests, "publish", overtaken)
    table.merge(rows(15, "c"))
    assert calls == [2, 2, 3]
    titles = {r.job_url: r.job_title for r in table.read(spark).collect()}
    assert titles == {f"u{i}": "a" if i < 10 else "b" if i < 15 else "c" for i in range(35)}


def test_further_columns_and_empty_merges(spark, tmp_path):
    table = BucketedTable(str(tmp_path), buckets=2)
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    table.merge(spark.createDataFrame([(1, "a", "t")], LAYOUT))
    table.merge(spark.createDataFrame([(1, "b", "t", "new")], LAYOUT + ", place STRING"))
    table.merge(spark.createDataFrame([(1, None, "t")], LAYOUT))
    assert {(r.job_url, r.place) for r in table.read(spark).collect()} == {("a", None), ("b", "new")}
