"""Columns that are worked out once per row, whatever is done with them later."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that the optimizer does not inline.

    A filter on a projected column moves below the projection and takes a copy of its expression
    with it, for every mention of the column. Text parsing is too costly for that: one filter on a
    pay label would parse each text a dozen times. A generator keeps the expression in one place,
    and filters on other columns still move below it.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
