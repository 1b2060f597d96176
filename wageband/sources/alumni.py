"""Alumni survey rows: the band comes from the pay actually earned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.functions.salary import band_id, band_label
from wageband.schemas import ALUMNI_SCHEMA, TARGET_COLUMN, WAGE_BANDS, WageBand
from wageband.sources.delimited import PROVENANCE, read_delimited
from wageband.operators.merge import POSITION


def read_alumni(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, ALUMNI_SCHEMA, sep=None).drop(PROVENANCE, POSITION)


def with_alumni_band(alumni: DataFrame, bands: Sequence[WageBand] = WAGE_BANDS) -> DataFrame:
    pay = F.col("starting_salary")
    return alumni.withColumns({
        "salary_range_id": band_id(pay, bands), TARGET_COLUMN: band_label(pay, bands)})
