from pyspark.sql import functions as F

from wageband.functions import text as X
from wageband.functions.features import (
    job_family, with_features, with_posting_text, with_region_group, with_repaired_region,
)
from wageband.functions.vocab import FLAG_KEYWORDS
from wageband.schemas import FEATURE_COLUMNS, RAW_SCHEMA

BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def test_every_blank_collapses(evaluate):
    assert len(BLANKS) == 29
    texts = [f"{b}A{b}{b} B{b}c{b}" for b in BLANKS] + ["".join(BLANKS), None, "x  y", "plain"]
    expected = ["a b c"] * 29 + ["", "", "x y", "plain"]
    assert evaluate(lambda t: X.normalize_text(t), texts) == expected
    assert evaluate(lambda t: X.clean_text(t), ["  Ab\n\nC ", None, "Été  là"]) == ["Ab C", "", "Été là"]
    assert evaluate(lambda t: X.strip_blanks(t), ["　 a b\t"]) == ["a b"]


def test_blank_tests_are_plain_patterns(spark):
    plan = spark.createDataFrame([("a",)], "t STRING").select(
        X.clean_text(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    # Alternatives and look aheads are tried at every character.
    assert "(?=" not in plan and "|" not in plan


def test_parts_join(spark):
    row = spark.createDataFrame([("Data\xa0 Analyst", None, "A\tB")], "a STRING, b STRING, c STRING")
    joined = X.normalize_text(F.col("a"), F.coalesce("b", F.lit("nan")), F.col("c"))
    assert row.select(joined).first()[0] == "data analyst nan a b"


def test_keywords_pruned_without_changing_the_test(evaluate):
    for words in FLAG_KEYWORDS.values():
        short = X.shortest_keywords(words)
        assert all(any(s in w for s in short) for w in words)
    assert evaluate(lambda t: X.contains_any(t, ["internship", "intern", "magang"]),
                    ["international", "magan", ""]) == [1, 0, 0]


def test_min_gpa(evaluate):
    cases = {
        "ipk minimum 3,25": 3.25, "ipk: 3.5": 3.5, "gpa >= 3": 3.0, "ipk 30": 3.0, "ipk > 3": None,
        "ipk kumulatif 3.5": None, "gpa 4.5 minimum gpa 3.0": 3.0, "ipk 4.5": None, "none": None,
        "ipk 4.2 gpa 3.1": 3.1, "ipk lebih dari 2.75": 2.75,
    }
    assert evaluate(lambda t: X.min_gpa(t), list(cases)) == list(cases.values())


def test_experience_years(evaluate):
    cases = {
        "minimal 2 tahun pengalaman": 2, "2-3 tahun pengalaman": 3,
        "1 year experience, 3 years experience": 1, "pengalaman minimal 2 tahun": 2,
        "pengalaman kerja minimal 2 tahun": 0, "2 years of experience": 0, "": 0,
        "at least 12 thn experience": 12, "experience min 4 years": 4,
    }
    assert evaluate(lambda t: X.experience_years(t), list(cases)) == list(cases.values())


def test_job_family(evaluate):
    cases = {
        "senior sql developer": "data", "web developer": "software", "sales engineer": "business",
        "tax admin": "finance", "admin teknik": "administration", "civil engineer": "engineering",
        "barista": "other",
    }
    assert evaluate(job_family, list(cases)) == list(cases.values())


def test_regions(spark):
    cases = {
        "Jakarta Selatan": ("jabodetabek", "jabodetabek"), "Cikarang": ("lainnya", "jabodetabek"),
        "Karawang": ("lainnya", "jawa barat"), "Cimahi": ("jawa barat", "lainnya"),
        "Solo": ("jawa tengah diy", "lainnya"), "Kota Batang": ("lainnya", "jawa tengah diy"),
        "Jawa Timur": ("lainnya", "jawa timur"),
        "Semarang dan Malang": ("jawa timur", "jawa tengah diy"),
        "Medan, Kalimantan": ("kalimantan", "sumatera"), "Sumatera Utara": ("sumatera", "lainnya"),
        "Manado": ("sulawesi", "lainnya"), "Pontianak": ("lainnya", "kalimantan"),
        "  ": ("unknown", "lainnya"), None: ("lainnya", "lainnya"),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "location STRING")
    both = with_repaired_region(with_region_group(rows), "repaired")
    assert {r.location: (r.region_group, r.repaired) for r in both.collect()} == cases


def test_slug(evaluate):
    assert evaluate(lambda t: X.slug(t), [" 01 IT/Software! ", "a--b", "__"]) == ["01_it_software", "a_b", ""]


def test_pay_snippet(evaluate):
    whole = "Admin Staff Jakarta Gaji Rp 4.000.000 per bulan"
    four = " ".join(["x"] * 20 + ["Rp1"] + ["y"] * 20 + ["2jt"] + ["z"] * 20 + ["IDR"] + ["w"] * 20 + ["rp"])
    found = evaluate(lambda t: X.pay_snippet(t), [whole, "per bulan saja", "PT Corp Maju", "", None, four])
    assert found[:3] == [whole, "", "PT Corp Maju"]
    assert found[3] == "" and not found[4]
    chunks = found[5].split(" | ")
    assert len(chunks) == 3 and chunks[0].split() == ["x"] * 6 + ["Rp1"] + ["y"] * 9


def test_features_see_null_as_nan_and_fire(spark):
    row = (None, "Data Analyst", None, None, None, "ipk kumulatif, security, word", None, None)
    rows = spark.createDataFrame([row], RAW_SCHEMA)
    made = with_features(with_posting_text(rows))
    assert set(FEATURE_COLUMNS) <= set(made.columns)
    first = made.first()
    assert first["_feature_text"] == "data analyst nan nan nan ipk kumulatif, security, word"
    assert first["_pay_text"] == "data analyst ipk kumulatif, security, word"
    assert (first.f_ipk_required, first.f_min_gpa, first.f_major_it) == (1, 0.0, 1)
    assert first.f_computer_skill_required == 1 and first.region_group == "lainnya"
