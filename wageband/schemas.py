"""Table layouts, wage bands and null tokens shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The column names of the stored tables.
RAW_COLUMNS = [
    "source_keyword", "job_title", "company", "location",
    "salary_text", "job_description", "job_url", "scraped_at",
]

FLAG_COLUMNS = [
    "f_education_d3", "f_education_s1", "f_education_s2", "f_ipk_required", "f_min_gpa",
    "f_major_it", "f_major_engineering", "f_major_business", "f_academic_achievement",
    "f_scholarship", "f_transcript_required", "f_certificate_required", "f_english_required",
    "f_computer_skill_required", "f_portfolio_required", "f_project_required",
    "f_organization_required", "f_leadership_required", "f_student_cadre_proxy",
    "f_event_committee", "f_communication_required", "f_teamwork_required",
    "f_internship_required", "f_fresh_graduate_allowed", "f_work_experience_required",
    "f_experience_years_min",
]
CATEGORY_COLUMNS = ["job_family", "region_group"]
FEATURE_COLUMNS = FLAG_COLUMNS + CATEGORY_COLUMNS
TARGET_COLUMN = "salary_range_label"

SALARY_COLUMNS = [
    "salary_min", "salary_max", "salary_avg",
    "salary_range_id", TARGET_COLUMN, "salary_available",
]
PROXY_COLUMNS = (
    ["source_id", "source_keyword", "scraped_at", "job_title", "company", "location",
     "job_url", "salary_text"] + SALARY_COLUMNS + FEATURE_COLUMNS
)
METADATA_COLUMNS = [
    "source_id", "job_title", "company", "location", "job_url", "salary_avg", "salary_range_id",
]
TRAINING_COLUMNS = METADATA_COLUMNS + FEATURE_COLUMNS + [TARGET_COLUMN]

_LONG = {"source_id", "salary_min", "salary_max", "salary_avg"}
_INT = {"salary_range_id", "salary_available"} | (set(FLAG_COLUMNS) - {"f_min_gpa"})


def _field(name: str) -> T.StructField:
    if name in _LONG:
        return T.StructField(name, T.LongType())
    if name in _INT:
        return T.StructField(name, T.IntegerType())
    if name == "f_min_gpa":
        return T.StructField(name, T.DoubleType())
    return T.StructField(name, T.StringType())


RAW_SCHEMA = T.StructType([_field(c) for c in RAW_COLUMNS])
PROXY_SCHEMA = T.StructType([_field(c) for c in PROXY_COLUMNS])
TRAINING_SCHEMA = T.StructType([_field(c) for c in TRAINING_COLUMNS])

# The 22 survey columns, with the types they are read as.
_ALUMNI_STRINGS = [
    "gender", "degree", "major_category", "employment_region", "employment_industry",
    "company_type", "salary_range_label",
]
_ALUMNI_COLUMNS = [
    "respondent_id", "gender", "graduation_year", "degree", "major_category", "gpa",
    "certificate_count", "english_certificate", "computer_certificate", "portfolio_count",
    "project_count", "internship_experience", "organization_experience",
    "leadership_experience", "student_cadre_experience", "competition_count",
    "scholarship_count", "employment_region", "employment_industry", "company_type",
    "starting_salary", "salary_range_label",
]


def _alumni_type(name: str) -> T.DataType:
    if name in _ALUMNI_STRINGS:
        return T.StringType()
    return {"gpa": T.DoubleType(), "starting_salary": T.LongType()}.get(name, T.IntegerType())


ALUMNI_SCHEMA = T.StructType([T.StructField(c, _alumni_type(c)) for c in _ALUMNI_COLUMNS])

# Cell texts that a delimited file uses for "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

UNKNOWN_LABEL = "unknown"


@dataclass(frozen=True)
class WageBand:
    """One half-open band ``[lower, next lower)`` in rupiah per month."""

    lower: int
    label: str


# The seven wage bands; the last one has no upper bound.
WAGE_BANDS = (
    WageBand(0, "0 sampai < 1 juta"),
    WageBand(1_000_000, "1 sampai < 2 juta"),
    WageBand(2_000_000, "2 sampai < 4 juta"),
    WageBand(4_000_000, "4 sampai < 6 juta"),
    WageBand(6_000_000, "6 sampai < 8 juta"),
    WageBand(8_000_000, "8 sampai < 10 juta"),
    WageBand(10_000_000, ">= 10 juta"),
)

# The older five-class banding still found in documents and old files.
FIVE_BANDS = (
    WageBand(0, "< 4 juta"),
    WageBand(4_000_000, "4 sampai < 6 juta"),
    WageBand(6_000_000, "6 sampai < 8 juta"),
    WageBand(8_000_000, "8 sampai < 10 juta"),
    WageBand(10_000_000, ">= 10 juta"),
)

BAND_LABELS = [b.label for b in WAGE_BANDS]
LOW_BAND_LABELS = BAND_LABELS[:2]

# Rows wanted per class, rows kept per search keyword.
TARGET_PER_CLASS = 771
JOBS_PER_KEYWORD = 100
PAGES_PER_KEYWORD = 10
