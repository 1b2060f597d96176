import pytest
from pyspark.sql import functions as F

from wageband.operators.merge import union_pieces
from wageband.plans.datasets import build_training_table, existing_columns
from wageband.schemas import (
    PROXY_COLUMNS, PROXY_SCHEMA, RAW_COLUMNS, RAW_SCHEMA, TRAINING_COLUMNS, TRAINING_SCHEMA,
)
from wageband.plans.quota_run import run_quota
from wageband.sources import alumni, delimited, files, registry
from wageband.sources.tables import (
    Manifests, PublicationConflict, PublishedTables, VersionedTable, write_batch,
)


def test_layouts():
    assert (len(RAW_COLUMNS), len(PROXY_COLUMNS), len(TRAINING_COLUMNS)) == (8, 42, 36)
    assert len(registry.KEYWORD_BATCHES) == 9
    assert [len(v) for v in registry.KEYWORD_BATCHES.values()] == [9, 7, 14, 6, 7, 7, 7, 5, 45]
    assert len(registry.LOW_WAGE_KEYWORDS) == 54


def test_awkward_cells(spark, tmp_path):
    path = tmp_path / "raw_batch_01.csv"
    path.write_bytes(
        b'\xef\xbb\xbfsource_keyword,job_title,company,location,salary_text,job_description,job_url,scraped_at\n'
        b'k,"two\nlines","say ""hi""",NA, ,None,u1,null\n'
        b'k2,  t,nan,x,Rp 5,"a,b",u2,2024-01-01 00:00:00\n')
    rows = delimited.read_delimited(spark, str(path)).orderBy("pos").collect()
    first, second = rows
    assert (first.job_title, first.company) == ("two\nlines", 'say "hi"')
    assert (first.location, first.salary_text, first.job_description, first.scraped_at) == (
        None, " ", None, None)
    assert (second.job_title, second.company, second.job_description) == ("  t", None, "a,b")
    assert first.source_batch_file == "raw_batch_01.csv" and first.pos < second.pos


def test_missing_and_empty_files(spark, tmp_path):
    missing = delimited.read_delimited(spark, str(tmp_path / "none.csv"))
    assert missing.count() == 0 and set(RAW_COLUMNS) <= set(missing.columns)
    (tmp_path / "empty.csv").write_text("")
    assert delimited.read_delimited(spark, str(tmp_path / "empty.csv")).count() == 0
    assert delimited.read_delimited(spark, str(tmp_path / "none.csv"), sep=None).count() == 0


def test_separator_and_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("job_url;salary_avg\nu1;5\nu2;x\n")
    (tmp_path / "b.csv").write_text("extra;job_url\ne;u3\n")
    paths = [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]
    rows = delimited.read_delimited(spark, paths, TRAINING_SCHEMA, sep=None)
    assert rows.schema["salary_avg"].dataType.simpleString() == "bigint"
    assert {(r.job_url, r.salary_avg, r.extra, r.source_batch_file) for r in rows.collect()} == {
        ("u1", 5, None, "a.csv"), ("u2", None, None, "a.csv"), ("u3", None, "e", "b.csv")}


def test_one_bad_path_spoils_nothing(spark, tmp_path):
    (tmp_path / "01.csv").write_text("job_url,job_title,source_batch_file\nu1,t1,old\n")
    (tmp_path / "02.csv").write_text("job_title,job_url\nt2,u2\n")
    (tmp_path / "03.csv").write_text("")
    rows = delimited.read_delimited(spark, [str(tmp_path / "0*.csv"), str(tmp_path / "none.csv")])
    assert {(r.job_url, r.job_title, r.source_batch_file) for r in rows.collect()} == {
        ("u1", "t1", "01.csv"), ("u2", "t2", "02.csv")}


def test_names_that_need_encoding_are_read(spark, tmp_path):
    names = ["raw batch 1.csv", "raw_2.csv", "50%.csv", "a%20b+c.csv", "x[1].csv", "{y}.csv", "ü ñ.csv"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f"job_url,job_title\nu{i},t\n")
    rows = delimited.read_delimited(spark, str(tmp_path))
    assert {(r.job_url, r.source_batch_file) for r in rows.collect()} == {(f"u{i}", n) for i, n in enumerate(names)}
    one = delimited.read_delimited(spark, str(tmp_path / "raw batch*.csv"))
    assert [r.source_batch_file for r in one.collect()] == ["raw batch 1.csv"]


def test_headers_with_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "1.csv").write_text('"pay\nmonthly",job_url\n5,u1\n')
    (tmp_path / "2.csv").write_text('"pay\nyearly",job_url\n60,u2\n')
    (tmp_path / "3.csv").write_text('\n\n"pay\nyearly",job_url\n70,u3\n')
    rows = delimited.read_delimited(spark, str(tmp_path / "*.csv"))
    assert {(r["pay\nmonthly"], r["pay\nyearly"], r.job_url) for r in rows.collect()} == {
        ("5", None, "u1"), (None, "60", "u2"), (None, "70", "u3")}


def test_looking_at_headers_does_not_read_the_files(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("job_url,job_title\n" + "u,some title of a posting\n" * 2_000_000)
    read = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    before = read.getLong("bytesRead")
    assert list(delimited._headers(spark, [f"file:{path}"])) == ["job_url,job_title"]
    assert read.getLong("bytesRead") - before < path.stat().st_size / 10


def test_order_follows_file_names(spark, tmp_path):
    from wageband.operators.dedup import keep_last

    (tmp_path / "01.csv").write_text("job_url,job_title\nu,small\n")
    (tmp_path / "02.csv").write_text("job_url,job_title\n" + "".join(f"x{i},y\n" for i in range(500)) + "u,large\n")
    rows = delimited.read_delimited(spark, str(tmp_path / "*.csv"))
    kept = {r.job_url: r.job_title for r in keep_last(rows, delimited.FILE_ORDER).collect()}
    assert kept["u"] == "large"


def test_export_keeps_blanks_and_quotes(spark, tmp_path):
    row = ("k", "  lead", 'q"x', "a\nb", " ", "x,y", "u", "s")
    delimited.write_delimited(spark.createDataFrame([row], RAW_SCHEMA), str(tmp_path / "out"))
    back = delimited.read_delimited(spark, str(tmp_path / "out")).select(*RAW_COLUMNS).first()
    assert tuple(back) == row


def test_versions_survive_a_failed_writer(spark, tmp_path):
    table = VersionedTable(str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read(spark)
    assert table.write(spark.range(3).toDF("x")) == 1
    # The new version is computed from the one before.
    assert table.write(table.read(spark).filter("x > 0")) == 2
    (tmp_path / "t" / "v=3").mkdir()
    assert table.versions(spark) == [1, 2]
    assert table.read(spark).count() == 2 and table.read(spark, 1).count() == 3
    assert table.write(spark.range(1).toDF("x")) == 3 and table.read(spark).count() == 1


def test_batches_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "batch_name STRING, x INT")
    write_batch(rows, path)
    write_batch(rows.filter("batch_name = 'b'").withColumn("x", F.lit(2)), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("batch_name", "x").collect()} == {
        ("a", 1), ("b", 2)}


def test_publish_and_balance(spark, tmp_path):
    raw = spark.createDataFrame(
        [(i, "k", "Admin", None, "Bandung", f"Rp {3 + i % 3}.000.000" if i % 4 else None, "d",
          f"u{i}", "2024-01-01 00:00:00") for i in range(20)],
        "pos BIGINT, " + ", ".join(f"{c} STRING" for c in RAW_COLUMNS))
    tables = PublishedTables(str(tmp_path))
    tables.publish(raw)
    proxy = tables.proxy.read(spark)
    assert proxy.columns == PROXY_COLUMNS
    assert [f.dataType for f in proxy.schema] == [f.dataType for f in PROXY_SCHEMA]
    assert sorted(r.source_id for r in proxy.collect()) == list(range(1, 21))
    training = tables.training.read(spark)
    assert training.columns == TRAINING_COLUMNS and training.count() == 15
    tables.balance(spark, 2)
    assert tables.training.versions(spark) == [1, 2]
    assert {r["count"] for r in tables.training.read(spark).groupBy("salary_range_label").count().collect()} == {2}


def _raw_rows(spark, start, stop):
    return spark.createDataFrame(
        [(i, "k", "Admin", None, "Bandung", f"Rp {3 + i % 3}.000.000", "d", f"u{i}", "2024-01-01 00:00:00")
         for i in range(start, stop)], "pos BIGINT, " + ", ".join(f"{c} STRING" for c in RAW_COLUMNS))


def test_a_crash_while_publishing_changes_no_table(spark, tmp_path, monkeypatch):
    tables = PublishedTables(str(tmp_path))
    tables.publish(_raw_rows(spark, 0, 5))

    def crash(proxy):
        raise RuntimeError("crash")

    with monkeypatch.context() as broken:
        broken.setattr("wageband.sources.tables.build_training_table", crash)
        with pytest.raises(RuntimeError, match="crash"):
            tables.publish(_raw_rows(spark, 0, 9))
    # Raw and proxy of the new state are on the disk, and no reader sees them.
    assert [t.read(spark).count() for t in (tables.raw, tables.proxy, tables.training)] == [5, 5, 5]
    assert tables.manifests.remove_unpublished(spark) == 1
    assert tables.publish(_raw_rows(spark, 0, 9)).number == 2
    assert tables.manifests.remove_unpublished(spark) == 0
    assert [tables.state(spark, n).read(spark, "training").count() for n in (1, 2)] == [5, 9]


def test_two_writers_cannot_publish_the_same_state(spark, tmp_path):
    tables = PublishedTables(str(tmp_path))
    tables.publish(_raw_rows(spark, 0, 5))
    number = tables.state(spark).number
    tables.publish(_raw_rows(spark, 0, 7), after=number)
    with pytest.raises(PublicationConflict):
        tables.publish(_raw_rows(spark, 0, 6), after=number)
    assert tables.state(spark).number == 2 and tables.raw.read(spark).count() == 7


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    manifests = Manifests(str(tmp_path / "m"))

    def claim(writer):
        try:
            return manifests.publish(spark, 1, {"t": f"{manifests.root}/data-{writer}"}).folders["t"]
        except PublicationConflict:
            return None

    files.write_once(spark, f"{manifests.root}/other", "")
    with ThreadPoolExecutor(8) as pool:
        won = [w for w in pool.map(claim, range(16)) if w]
    assert len(won) == 1 and manifests.read(spark).folders["t"] == won[0]
    table = VersionedTable(str(tmp_path / "t"))
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda i: table.write(spark.range(i)), range(4))) == [1, 2, 3, 4]


def test_a_quota_run_starts_again_when_another_publishes(spark, tmp_path, monkeypatch):
    tables, target = PublishedTables(str(tmp_path)), 4
    tables.publish(_raw_rows(spark, 0, 6))
    publish, calls = PublishedTables.publish, []

    def overtaken(self, raw, *args, **kw):
        calls.append(kw.get("after"))
        if len(calls) == 1:
            publish(self, _raw_rows(spark, 0, 9))  # another run takes three of the arrivals first
        return publish(self, raw, *args, **kw)

    monkeypatch.setattr(PublishedTables, "publish", overtaken)
    assert run_quota(tables, _raw_rows(spark, 6, 60), target=target)
    assert calls == [1, 2]
    raw = tables.raw.read(spark)
    assert raw.count() == raw.select("job_url").distinct().count()
    sizes = tables.training.read(spark).groupBy("salary_range_label").count().collect()
    assert max(r["count"] for r in sizes) <= 8 and tables.state(spark).number == 3


def test_batches_fold_into_the_combined_table(spark, tmp_path):
    def batch(*urls):
        return spark.createDataFrame(
            [(i, "k", t, None, "Bandung", "Rp 5.000.000", "d", u, "2024") for i, (u, t) in enumerate(urls)],
            "pos BIGINT, " + ", ".join(f"{c} STRING" for c in RAW_COLUMNS))

    tables = PublishedTables(str(tmp_path))
    tables.publish(batch(("a", "old"), ("o", "old")))
    tables.publish_batch("01 First", batch(("a", "one"), ("b", "one")))
    tables.publish_batch("02 Second", batch(("b", "wrong")))
    tables.publish_batch("02 Second", batch(("b", "two"), (None, "two")))
    tables.publish_combined(spark)
    assert [(r.job_url, r.job_title) for r in tables.raw.read(spark).orderBy("pos").collect()] == [
        ("o", "old"), ("a", "one"), ("b", "two")]
    assert tables.training.read(spark).count() == 3
    stored = spark.read.parquet(str(tmp_path / "batches" / "training"))
    assert {r.batch_name: r["count"] for r in stored.groupBy("batch_name").count().collect()} == {
        "01_first": 2, "02_second": 2}


def test_training_rows_of_a_batch_come_from_its_written_proxy(spark, tmp_path, monkeypatch):
    from wageband.sources import tables as published

    plans, build = [], published.build_training_table

    def noted(proxy):
        plans.append((proxy._jdf.queryExecution().executedPlan().toString(), proxy.inputFiles()))
        return build(proxy)

    monkeypatch.setattr(published, "build_training_table", noted)
    raw = spark.createDataFrame([(1, "k", "t", "c", "Bandung", "Rp 5.000.000", "d", "a", "2024")],
                                "pos BIGINT, " + ", ".join(f"{c} STRING" for c in RAW_COLUMNS))
    tables = PublishedTables(str(tmp_path))
    tables.publish_batch("01", raw)
    (plan, read), = plans
    assert "regexp_extract" not in plan and all("/batches/proxy/" in f for f in read)
    stored = spark.read.parquet(str(tmp_path / "batches" / "training"))
    assert stored.drop("batch_name").columns == TRAINING_COLUMNS and stored.first().salary_avg == 5_000_000


def test_missing_columns_are_tolerated(spark):
    a = spark.createDataFrame([("u",)], "job_url STRING")
    b = spark.createDataFrame([("t", "v")], "job_title STRING, job_url STRING")
    assert union_pieces([a, b]).columns == ["job_url", "piece_no", "job_title"]
    assert existing_columns(b, ["x", "job_url"]).columns == ["job_url"]
    empty = spark.createDataFrame([], PROXY_SCHEMA)
    assert build_training_table(empty).columns == TRAINING_COLUMNS


@pytest.mark.parametrize("argument, name", [
    ("1", "01_umum_fresh_graduate"), (" 9 ", "09_balance_salary"),
    ("finance", "05_finance_accounting_tax_audit"), ("Admin", "06_admin_operation_logistic"),
    ("03_it_software", "03_it_software"),
    ("10", "no such number"), ("0", "no such number"), ("it", "ambiguous"), ("xyz", "not found"),
    ("99999999999", "no such number"), ("", "ambiguous"),
])
def test_batch_choice(spark, argument, name):
    if name in registry.KEYWORD_BATCHES:
        assert registry.batch_name_for(argument, spark=spark) == name
    else:
        with pytest.raises(ValueError, match=name):
            registry.batch_name_for(argument, spark=spark)


def test_frontier(spark):
    words = spark.createDataFrame([("a b*~/é",)], "keyword STRING")
    rows = registry.crawl_frontier(words, "https://h", 2).orderBy("page").collect()
    assert [r.search_url for r in rows] == [
        f"https://h/jobs?keywords=a+b%2A~%2F%C3%A9&page={i}" for i in (1, 2)]
    assert registry.keyword_registry(spark).count() == 107


def test_alumni(spark, tmp_path):
    path = tmp_path / "alumni.csv"
    path.write_text("respondent_id,gpa,starting_salary,salary_range_label\n1,3.5,4500000,\n2,,,\n")
    rows = alumni.with_alumni_band(alumni.read_alumni(spark, str(path))).orderBy("respondent_id")
    assert [(r.gpa, r.salary_range_label) for r in rows.collect()] == [
        (3.5, "4 sampai < 6 juta"), (None, "unknown")]
