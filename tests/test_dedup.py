from pyspark.sql import functions as F

from wageband.operators import dedup, merge
from wageband.operators.ranking import rank_within, with_file_row_id, with_row_id


def _rows(spark):
    return spark.createDataFrame(
        [(1, "A"), (2, None), (3, "B"), (4, None), (5, "A")], "pos BIGINT, job_url STRING")


def _kept(df):
    return sorted(r.pos for r in df.collect())


def test_keep_policies(spark):
    rows = _rows(spark)
    assert _kept(dedup.keep_last(rows, ["pos"])) == [3, 5]
    assert _kept(dedup.keep_first(rows, ["pos"])) == [1, 3]
    assert _kept(dedup.keep_first_by_cascade(rows, ["pos"])) == [1, 2, 3]
    assert _kept(dedup.keep_last_with_nulls(rows, ["pos"])) == [3, 4, 5]
    again = dedup.keep_last(dedup.keep_last(rows, ["pos"]), ["pos"])
    assert _kept(again) == [3, 5]


def test_cascade_and_whole_rows(spark):
    rows = spark.createDataFrame(
        [(1, "t", "c", 1), (2, "t", "c", 2), (3, "t", None, 3), (4, "t", None, 4)],
        "pos BIGINT, title STRING, company STRING, x INT")
    assert _kept(dedup.keep_first_by_cascade(rows, ["pos"])) == [1, 3]
    assert _kept(dedup.keep_first_by_cascade(rows.withColumn("url", F.lit("u")), ["pos"])) == [1]
    assert _kept(dedup.keep_last(rows.drop("x"), ["pos"])) == [2, 4]


def test_merge_presets(spark):
    def piece(name, *urls):
        return spark.createDataFrame([(i, u, name) for i, u in enumerate(urls)],
                                     "pos BIGINT, job_url STRING, origin STRING")

    old, one, two = piece("old", "A", "O"), piece("batch_01", "A", "B"), piece("batch_02", "A", "B")

    def origins(df):
        return {r.job_url: r.origin for r in df.collect()}

    assert origins(merge.merge_latest_wins(old, [one, two])) == {
        "A": "batch_02", "B": "batch_02", "O": "old"}
    files = one.unionByName(two).withColumn("source_batch_file", F.col("origin"))
    assert origins(merge.merge_first_wins(files)) == {"A": "batch_01", "B": "batch_01"}
    assert origins(merge.merge_existing_wins(old, one)) == {"A": "old", "O": "old", "B": "batch_01"}
    assert origins(merge.merge_session(old, one, two.drop("origin"))) == {
        "A": None, "B": None, "O": "old"}
    counts = merge.merge_counts(files, merge.merge_first_wins(files), "source_batch_file")
    assert {r.source_batch_file: (r.rows_before, r.rows_after, r.rows_removed)
            for r in counts.collect()} == {"batch_01": (2, 2, 0), "batch_02": (2, 0, 2)}


def test_skip_known(spark):
    arrivals = spark.createDataFrame(
        [(1, "A"), (2, " B\xa0"), (3, "B"), (4, None), (5, "  "), (6, "C"), (7, "C")],
        "pos BIGINT, job_url STRING")
    known = spark.createDataFrame([("A",), (None,)], "job_url STRING")
    assert _kept(dedup.skip_known(arrivals, known, ["pos"])) == [2, 6]


def test_hot_key_is_cut_before_the_shuffle(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("job_url"))
    kept = dedup.keep_last(rows, ["pos"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert kept.count() == 2001
    assert kept.filter("job_url = 'hot'").first().pos == 2997


def test_rank_within_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"))
    ranked = rank_within(rows, ["g"], ["pos"], 40).collect()
    for group, step in (("hot", lambda p: p % 3 == 0), ("cold", lambda p: p % 3 != 0)):
        expected = [p for p in range(5000) if step(p)][:40]
        assert [r.pos for r in sorted(ranked, key=lambda r: r.pos) if r.g == group] == expected
    many = rank_within(rows, ["g"], ["pos"], 1500)
    assert many.count() == 3000


def test_row_id_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7).alias("pos"), (F.col("id") % 2).alias("f"))
    plain = with_row_id(rows, "pos", block=64).orderBy("pos").collect()
    assert [r.source_id for r in plain] == list(range(1, 1001))
    grouped = with_row_id(rows, "pos", ["f"], block=64).orderBy("f", "pos").collect()
    assert [r.source_id for r in grouped] == list(range(1, 1001))


def test_row_id_from_files(spark, tmp_path):
    for name, start in (("a", 0), ("b", 50), ("c", 120)):
        spark.range(start, start + 70).coalesce(1).write.parquet(str(tmp_path / f"f={name}"))
    whole = spark.read.parquet(str(tmp_path))
    rows = with_file_row_id(whole).orderBy("f", "id").collect()
    assert [r.source_id for r in rows] == list(range(1, 211))


def test_row_id_loses_no_row(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("a", None), ("b", 3)], "f STRING, pos BIGINT")
    assert sorted(r.source_id for r in with_row_id(rows, "pos", ["f"]).collect()) == [1, 2, 3, 4]
    assert sorted(r.source_id for r in with_row_id(rows, "pos").collect()) == [1, 2, 3, 4]


def test_blank_url_is_none(spark):
    rows = spark.createDataFrame([("", 1), ("", 2), ("u", 3)], "job_url STRING, pos BIGINT")
    assert [r.job_url for r in dedup.keep_last(rows, ["pos"]).collect()] == ["u"]


def test_counts_of_a_null_source(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "f STRING, pos BIGINT")
    assert {(r.f, r.rows_after, r.rows_removed) for r in merge.merge_counts(rows, rows, "f").collect()} == {
        (None, 1, 0), ("a", 1, 0)}
