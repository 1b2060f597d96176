import os
import random
import time

from wageband.operators import balance, report
from wageband.operators.dedup import URL, skip_known
from wageband.plans.datasets import with_pay
from wageband.schemas import BAND_LABELS, TARGET_COLUMN
from wageband.sources import files
from wageband.streaming import ingest
from wageband.streaming.seen import BUCKET, SEED, SeenUrls

QUOTA = 24
LAYOUT = ("pos BIGINT, source_keyword STRING, job_title STRING, location STRING, "
          "salary_text STRING, job_description STRING, job_url STRING")


def _raw(spark, start, stop):
    return spark.createDataFrame(
        [(i, "k", "Staf", "Bandung", f"Rp {1 + i % 7}.500.000" if i % 6 else None, "d",
          f"u{i % 90 if i % 3 else i}") for i in range(start, stop)], LAYOUT)


def _arrive(df, folder, name):
    target = os.path.join(folder, name)
    df.coalesce(1).write.parquet(target)
    stamp = time.time()
    for f in os.listdir(target):
        os.utime(os.path.join(target, f), (stamp, stamp))
    time.sleep(0.05)


def test_micro_batches_equal_one_batch(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "ledger")
    os.makedirs(source)
    ledger = ingest.Ledger(root)
    known = spark.createDataFrame([("u7",), (None,)], f"{URL} STRING")
    counts = report.class_counts(with_pay(_raw(spark, 0, 12)))
    ledger.seed(known, counts)

    def run():
        stream = ingest.read_arrivals(spark, f"{source}/*", _raw(spark, 0, 1).schema, 1)
        ingest.ingest_with_quota(stream, ledger, QUOTA).awaitTermination()

    _arrive(_raw(spark, 0, 60), source, "a")
    _arrive(_raw(spark, 60, 140), source, "b")
    run()
    _arrive(_raw(spark, 140, 400), source, "c")
    run()
    run()  # nothing new: nothing happens

    everything = _raw(spark, 0, 400)
    expected = balance.quota_accept(everything, with_pay(everything), known, counts, ["pos"], QUOTA)
    accepted = ledger.accepted(spark, everything.schema)
    assert sorted(r.pos for r in accepted.collect()) == sorted(r.pos for r in expected.collect())
    assert accepted.select("batch_id").distinct().count() == 3
    now = {r[TARGET_COLUMN]: r.n for r in ledger.counts(spark, 1 << 62).collect()}
    assert set(now) == set(BAND_LABELS) and max(now.values()) <= QUOTA
    assert ingest.quotas_full(ledger, spark, min(now.values()))


def test_replayed_micro_batch_gives_the_same_rows(spark, tmp_path):
    ledger = ingest.Ledger(str(tmp_path))
    rows = _raw(spark, 0, 80)
    ledger.seed(rows.filter("false"), report.class_counts(with_pay(rows.filter("false"))))
    ledger.take(rows.filter("pos < 40"), 0, 5)
    ledger.take(rows.filter("pos >= 40"), 1, 5)
    before = sorted(r.pos for r in ledger.accepted(spark, rows.schema).collect())
    ledger.take(rows.filter("pos >= 40"), 1, 5)
    assert sorted(r.pos for r in ledger.accepted(spark, rows.schema).collect()) == before


def test_running_counts_and_new_urls(spark, tmp_path):
    source = str(tmp_path / "in")
    os.makedirs(source)
    _arrive(_raw(spark, 0, 50), source, "a")
    schema = _raw(spark, 0, 1).schema
    for stop, name in ((50, None), (120, "b")):
        if name:
            _arrive(_raw(spark, 50, 120), source, name)
        stream = ingest.read_arrivals(spark, f"{source}/*", schema, 1)
        ingest.running_counts(with_pay(stream), str(tmp_path / "n")).awaitTermination()
        ingest.append_to(ingest.new_urls(stream), str(tmp_path / "u")).awaitTermination()
        rows = _raw(spark, 0, stop)
        counts = {tuple(r) for r in ingest.latest_counts(spark, str(tmp_path / "n")).collect()}
        assert counts == {tuple(r) for r in report.distribution(with_pay(rows)).collect()}
        urls = [r[0] for r in spark.read.parquet(str(tmp_path / "u" / "rows")).collect()]
        assert sorted(urls) == sorted(r[0] for r in rows.select(URL).distinct().collect())


def _urls(spark, numbers):
    return spark.createDataFrame([(f"u{i}",) for i in numbers], f"{URL} STRING")


def _found(rows):
    return sorted(r[0] for r in rows.select(URL).collect())


def test_seen_urls_against_a_set(spark, tmp_path):
    rng = random.Random(4)
    seen, known = SeenUrls(str(tmp_path), buckets=4, fan_in=3), set()
    for batch in range(11):
        urls = {rng.randrange(400) for _ in range(40)}
        arrived = _urls(spark, sorted(urls))
        assert _found(seen.unseen(arrived, batch)) == sorted(f"u{i}" for i in urls - known)
        seen.add(_urls(spark, sorted(urls - known)), batch)
        known |= urls
        assert seen.compact(spark, batch + 1) <= 5
    # 11 runs became 9 + 1 + 1, and every URL is in one run only.
    assert seen.runs(spark, 99) == [(0, 8), (9, 9), (10, 10)]
    stored = spark.read.option("recursiveFileLookup", "true").parquet(
        *[f"{seen._run(*r)}/urls" for r in seen.runs(spark, 99)])
    assert _found(stored) == sorted(f"u{i}" for i in known)


def test_a_lookup_reads_only_buckets_that_may_hold_its_urls(spark, tmp_path):
    seen = SeenUrls(str(tmp_path), buckets=16)
    seen.add(_urls(spark, range(2000)), 0)
    seen.add(_urls(spark, range(2000, 2100)), 1)
    one = _urls(spark, [5])
    assert len(seen._folders_hit(one, seen.runs(spark, 9))) == 1
    assert seen.unseen(one, 9).count() == 0
    new = _urls(spark, [-1])
    assert len(seen._folders_hit(new, seen.runs(spark, 9))) <= 1
    assert _found(seen.unseen(new, 9)) == ["u-1"]
    files_read = seen.unseen(one, 9).join(one, URL, "left_anti").inputFiles()
    assert {f.split(f"{BUCKET}=")[1].split("/")[0] for f in files_read if BUCKET in f} == {
        str(one.select(seen.bucket_of(one[URL])).first()[0])}
    assert seen.unseen(_urls(spark, []), 9).count() == 0


def test_an_unfinished_run_is_not_read(spark, tmp_path):
    seen = SeenUrls(str(tmp_path), buckets=2)
    seen.add(_urls(spark, [1]), 0)
    seen.add(_urls(spark, [2]), 1)
    files.remove(spark, f"{seen._run(1, 1)}/filters/_SUCCESS")
    assert seen.runs(spark, 9) == [(0, 0)]
    seen.add(_urls(spark, [2, 3]), 1)  # the micro-batch runs again
    assert _found(seen.unseen(_urls(spark, [1, 2, 3, 4]), 9)) == ["u4"]


def test_stream_stops_in_the_micro_batch_that_fills_the_quotas(spark, tmp_path):
    source, target = str(tmp_path / "in"), 3
    os.makedirs(source)
    ledger = ingest.Ledger(str(tmp_path / "ledger"))
    rows = _raw(spark, 0, 1)
    nothing = rows.filter("false")
    ledger.seed(nothing, report.class_counts(with_pay(nothing), BAND_LABELS[1:4]))
    for part in range(4):
        _arrive(_raw(spark, part * 60, part * 60 + 60), source, str(part))

    def run(**how):
        stream = ingest.read_arrivals(spark, f"{source}/*", rows.schema, 1)
        return ingest.fill_quotas(stream, ledger, target, **how)

    # Without availableNow the stream would never end by itself.
    assert run(available_now=False)
    everything = _raw(spark, 0, 240)
    counts = report.class_counts(with_pay(nothing), BAND_LABELS[1:4])
    expected = balance.quota_accept(everything, with_pay(everything), nothing, counts, ["pos"], target)
    accepted = ledger.accepted(spark, rows.schema)
    assert sorted(r.pos for r in accepted.collect()) == sorted(r.pos for r in expected.collect())
    assert len(files.names(spark, f"{ledger.root}/accepted")) < 4
    before = files.names(spark, f"{ledger.root}/progress/offsets")
    assert run() and files.names(spark, f"{ledger.root}/progress/offsets") == before


def test_new_rows_over_restarts(spark, tmp_path):
    source = str(tmp_path / "in")
    os.makedirs(source)
    seen, root = SeenUrls(str(tmp_path / "seen"), buckets=8, fan_in=2), str(tmp_path / "out")
    seen.add(_urls(spark, range(10)), SEED)
    for part, (start, stop) in enumerate([(0, 50), (50, 90), (90, 200)]):
        _arrive(_raw(spark, start, stop), source, str(part))
        stream = ingest.read_arrivals(spark, f"{source}/*", _raw(spark, 0, 1).schema)
        ingest.ingest_new(stream, seen, root).awaitTermination()
    expected = skip_known(_raw(spark, 0, 200), _urls(spark, range(10)), ["pos"])
    found = spark.read.parquet(f"{root}/fresh").select(*expected.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
