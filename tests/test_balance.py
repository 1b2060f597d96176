import random


from wageband.operators import balance, report
from wageband.plans.datasets import add_low_bands
from wageband.schemas import BAND_LABELS, LOW_BAND_LABELS, TARGET_COLUMN


def _labelled(spark, bands):
    rows = [(i + 1, f"u{i}", BAND_LABELS[b] if b is not None else "unknown")
            for i, b in enumerate(bands)]
    return spark.createDataFrame(rows, f"pos BIGINT, job_url STRING, {TARGET_COLUMN} STRING")


def _positions(df):
    return sorted(r.pos for r in df.collect())


def test_caps(spark):
    rows = _labelled(spark, [0, 0, 0, 1, 6, None])
    assert _positions(balance.cap_classes(rows, ["pos"], 2)) == [1, 2, 4, 5]
    rows = _labelled(spark, [0, 0, 1, 2, 2])
    assert _positions(balance.cap_some_classes(rows, ["pos"], LOW_BAND_LABELS, 1)) == [1, 3, 4, 5]


def test_counts(spark):
    rows = _labelled(spark, [0] * 8 + [1] * 2 + [None])
    counts = report.class_deficits(report.class_counts(rows), 7).collect()
    assert [(r[TARGET_COLUMN], r.n, r.deficit) for r in counts][:3] == [
        (BAND_LABELS[0], 8, 0), (BAND_LABELS[1], 2, 5), (BAND_LABELS[2], 0, 7)]
    assert report.class_counts(rows, cap=7).first().n == 7
    assert not report.targets_done(report.class_counts(rows), 2).first().done
    assert report.targets_done(report.class_counts(rows, LOW_BAND_LABELS), 2).first().done
    dist = [(r[0], r[1]) for r in report.distribution(rows).collect()]
    assert dist == [(BAND_LABELS[0], 8), (BAND_LABELS[1], 2), ("unknown", 1)]


def test_quota_fixture(spark):
    arrivals = spark.createDataFrame(
        [(1, "u1", BAND_LABELS[0]), (2, "u2", BAND_LABELS[0]), (3, "u3", BAND_LABELS[1]),
         (4, "u1", BAND_LABELS[0]), (5, "u4", "unknown"), (6, "u5", BAND_LABELS[2])],
        f"pos BIGINT, job_url STRING, {TARGET_COLUMN} STRING")
    counts = spark.createDataFrame([(BAND_LABELS[0], 1), (BAND_LABELS[1], 2)],
                                   f"{TARGET_COLUMN} STRING, n BIGINT")
    known = spark.createDataFrame([], "job_url STRING")
    taken = balance.quota_accept(arrivals.select("pos", "job_url"), arrivals, known, counts, ["pos"], 2)
    assert _positions(taken) == [1]


def test_quota_against_a_loop(spark):
    rng = random.Random(3)
    labels = BAND_LABELS[:3]
    data = [(i, f"u{rng.randint(0, 150)}", rng.choice(labels + ["unknown"])) for i in range(600)]
    known, have, target = {f"u{i}" for i in range(20)}, {labels[0]: 3, labels[1]: 0, labels[2]: 12}, 12
    seen, counts, expected = set(known), dict(have), []
    for pos, url, label in data:
        if url in seen:
            continue
        seen.add(url)
        if label in counts and counts[label] < target:
            counts[label] += 1
            expected.append(pos)
    arrivals = spark.createDataFrame(data, f"pos BIGINT, job_url STRING, {TARGET_COLUMN} STRING")
    taken = balance.quota_accept(
        arrivals.drop(TARGET_COLUMN), arrivals,
        spark.createDataFrame([(u,) for u in known], "job_url STRING"),
        spark.createDataFrame(list(have.items()), f"{TARGET_COLUMN} STRING, n BIGINT"), ["pos"], target)
    assert _positions(taken) == expected


def test_keyword_cap_against_a_loop(spark):
    rng = random.Random(5)
    words = {f"w{i}": i + 1 for i in range(5)}
    data = [(i, f"u{rng.randint(0, 60)}", rng.choice([*words, "unlisted"])) for i in range(500)]
    seen, expected = set(), []
    for word in words:
        taken = 0
        for pos, url, keyword in data:
            if keyword == word and url not in seen and taken < 9:
                seen.add(url)
                taken += 1
                expected.append(pos)
    rows = spark.createDataFrame(data, "pos BIGINT, job_url STRING, source_keyword STRING")
    assert _positions(balance.cap_keywords(rows, words, ["pos"], 9)) == sorted(expected)
    assert _positions(balance.cap_keywords(rows, words, ["pos"], 9, together=2)) == sorted(expected)
    assert _positions(balance.cap_keywords(rows, words, ["pos"], 9, together=1)) == sorted(expected)
    assert balance.cap_keywords(rows, {}, ["pos"], 9).count() == 0


def test_low_bands_replace_and_cap(spark):
    def piece(rows):
        return spark.createDataFrame(rows, "pos BIGINT, job_url STRING, salary_avg DOUBLE")

    base = piece([(1, "a", 5e5), (2, "b", 7e6), (3, "c", 6e5)])
    low = piece([(1, "c", 9e5), (2, "d", 8e5), (3, None, 7e5)])
    out = add_low_bands(base, low, n=2).collect()
    assert {(r.piece_no, r.job_url) for r in out} == {(0, "a"), (0, "b"), (1, "c")}
