"""The 26 posting features, job family and region as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.functions import vocab
from wageband.functions.once import with_columns_once
from wageband.functions.text import (
    contains_any, empty_to_null, experience_years, first_match, min_gpa, normalize_text,
)
from wageband.schemas import FEATURE_COLUMNS

_TEXT_COLUMNS = ["job_title", "company", "location", "salary_text", "job_description"]
_PAY_COLUMNS = ["salary_text", "job_title", "job_description"]


def job_family(text: Column | str) -> Column:
    return first_match(text, vocab.JOB_FAMILIES, F.lit(vocab.OTHER_FAMILY))


def _region() -> Column:
    """Region from ``_n_location``. A null location counts as some other place; only a blank one
    is unknown."""
    other = F.lit(vocab.OTHER_REGION)
    rest = F.when(F.col("_n_location") != "", other).otherwise(vocab.UNKNOWN_REGION)
    return F.when(F.col("location").isNull(), other).otherwise(
        first_match("_n_location", vocab.REGIONS, rest))


def _with_normal_location(df: DataFrame) -> DataFrame:
    return df.withColumn("_n_location", normalize_text(F.col("location")))


def with_region_group(df: DataFrame) -> DataFrame:
    return with_columns_once(
        _with_normal_location(df), {"region_group": _region()}).drop("_n_location")


def with_repaired_region(df: DataFrame, name: str = "region_group") -> DataFrame:
    """Region by the longer repair lists; never unknown."""
    region = first_match("_n_location", vocab.REPAIR_REGIONS, F.lit(vocab.OTHER_REGION))
    return with_columns_once(_with_normal_location(df), {name: region}).drop("_n_location")


def with_posting_text(df: DataFrame) -> DataFrame:
    """Add ``_feature_text``, ``_pay_text`` and ``_n_location``.

    Every source column is normalised once; joining normalised parts gives the same text as
    normalising the joined parts, so the long description is not scanned twice.
    """
    parts = df.withColumns({f"_n_{c}": normalize_text(F.col(c)) for c in _TEXT_COLUMNS
                            if c in df.columns})

    def joined(columns: list[str], missing: str | None) -> Column:
        present = []
        for c in columns:
            if c not in df.columns:
                continue
            part = empty_to_null(F.col(f"_n_{c}"))
            if missing is not None:
                part = F.when(F.col(c).isNull(), F.lit(missing)).otherwise(part)
            present.append(part)
        return F.concat_ws(" ", *present)

    return parts.withColumns({
        "_feature_text": joined(_TEXT_COLUMNS, "nan"),
        "_pay_text": joined(_PAY_COLUMNS, None),
    }).drop(*[f"_n_{c}" for c in _TEXT_COLUMNS if c != "location"])


def _feature_expressions(text: str) -> dict[str, Column]:
    """All features but the two parsed numbers, which ``with_features`` adds first."""
    gpa, years = F.col("_gpa"), F.col("f_experience_years_min")
    flags = {name: contains_any(text, words) for name, words in vocab.FLAG_KEYWORDS.items()}
    # A grade can only be found next to one of the two words, so the keyword test is enough.
    flags["f_min_gpa"] = F.coalesce(gpa, F.lit(0.0))
    flags["f_work_experience_required"] = (
        (years > 0) | (flags["f_work_experience_required"] == 1)).cast("int")
    flags["job_family"] = job_family(text)
    flags["region_group"] = _region()
    return flags


def with_features(df: DataFrame) -> DataFrame:
    """Add all features to rows that carry the columns of ``with_posting_text``."""
    column = F.col("_feature_text")
    parsed = df.withColumns({
        "_gpa": min_gpa(column), "f_experience_years_min": experience_years(column)})
    added = _feature_expressions("_feature_text")
    ordered = {name: added[name] for name in FEATURE_COLUMNS if name in added}
    return parsed.withColumns(ordered).drop("_gpa")
