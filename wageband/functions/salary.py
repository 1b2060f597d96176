"""Monthly pay from free text, and wage bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.functions import vocab
from wageband.functions.once import with_columns_once
from wageband.functions.text import mentions_any, normalize_text
from wageband.schemas import TARGET_COLUMN, UNKNOWN_LABEL, WAGE_BANDS, WageBand


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _rupiah(numeral: Column, millions: Column) -> Column:
    """Value of one numeral such as ``4.500.000`` or ``7,5`` with its unit."""
    # A separator next to a unit of millions is a decimal point. Double to bigint truncates.
    decimal = (F.replace(numeral, F.lit(","), F.lit(".")).try_cast("double")
               * F.lit(1_000_000.0)).try_cast("bigint")
    whole = F.regexp_replace(numeral, "[.,]", "").try_cast("bigint")
    return (
        F.when(millions & numeral.rlike("[.,]"), decimal)
        .when(millions & (whole < 1000), whole * 1_000_000)
        .when(whole.between(1000, 99_999), whole * 1000)
        .otherwise(whole)
    )


def _hits(text: Column, pattern: str, needs: Sequence[str]) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not needs:
        return found
    # Plain substring tests cost a fraction of a pattern scan.
    return F.when(mentions_any(text, needs), found).otherwise(F.array().cast("array<string>"))


def amounts(normalized: Column) -> Column:
    """All credible amounts in normalised text, in scan order, repeats included.

    Built in steps so that each lambda works on a finished value instead of repeating the
    extraction inside every branch.
    """
    hits = F.concat(*[_hits(normalized, *p) for p in vocab.AMOUNT_PATTERNS])
    parts = F.transform(hits, lambda h: F.struct(
        F.regexp_extract(h, "[0-9][0-9.,]*", 0).alias("numeral"),
        mentions_any(h, vocab.MILLION_MARKERS).alias("millions")))
    values = F.transform(parts, lambda p: _rupiah(p["numeral"], p["millions"]))
    credible = F.filter(values, lambda v: v.between(vocab.LOWEST_PAY, vocab.HIGHEST_PAY))
    # Every pattern needs a digit.
    return F.when(normalized.rlike("[0-9]"), credible)


def salary_values(text: Column) -> Column:
    """Distinct credible amounts in the order they are found; empty array if none."""
    found = F.array_distinct(amounts(normalize_text(text)))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def band_id(avg: Column, bands: Sequence[WageBand] = WAGE_BANDS) -> Column:
    """Index of the half-open band that holds the value; null below the first or for null."""
    reached = sum((avg >= F.lit(b.lower)).cast("int") for b in bands)
    return F.when(avg >= F.lit(bands[0].lower), reached - 1)


def band_label(avg: Column, bands: Sequence[WageBand] = WAGE_BANDS) -> Column:
    labels = F.array(*[F.lit(b.label) for b in bands])
    return F.coalesce(F.get(labels, band_id(avg, bands)), F.lit(UNKNOWN_LABEL))


def with_salary(df: DataFrame, normalized: str | Column,
                bands: Sequence[WageBand] = WAGE_BANDS) -> DataFrame:
    """Add pay range, wage band and availability from a column of normalised text."""
    text = F.col(normalized) if isinstance(normalized, str) else normalized
    avg = F.col("salary_avg")
    found = df.withColumn("_amounts", amounts(text))
    return (
        with_columns_once(found, {"salary_min": F.array_min("_amounts"),
                                  "salary_max": F.array_max("_amounts")})
        .drop("_amounts")
        .withColumn("salary_avg", F.expr("(salary_min + salary_max) div 2"))
        .withColumns({
            "salary_range_id": band_id(avg, bands),
            TARGET_COLUMN: band_label(avg, bands),
            "salary_available": avg.isNotNull().cast("int"),
        })
    )


def relabel_from_salary_avg(df: DataFrame, bands: Sequence[WageBand] = WAGE_BANDS) -> DataFrame:
    """Recompute the label from the stored average; the band id is left as it was."""
    if "salary_avg" not in df.columns:
        return df
    # A cast would also read type suffixes such as 5d; a number has digits, a point, an exponent.
    text = F.col("salary_avg").cast("string")
    numeric = df.withColumn("salary_avg", F.when(
        text.rlike(NUMBER), F.col("salary_avg").try_cast("double")))
    avg = F.when(F.abs("salary_avg") < float("inf"), F.col("salary_avg"))
    return numeric.withColumn("salary_avg", avg).withColumn(
        TARGET_COLUMN, band_label(F.col("salary_avg"), bands))
