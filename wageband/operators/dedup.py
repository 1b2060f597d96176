"""De-duplication by explicit policy, and skipping of known URLs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.functions.text import strip_blanks
from wageband.operators.ranking import first_per_key

# Key columns tried in this order by the cascade.
KEY_CASCADE = [["url"], ["job_url"], ["title", "company"]]
URL = "job_url"


def _directed(order: Sequence[str], keep: str) -> list[Column]:
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    return [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]


def deduplicate(df: DataFrame, order: Sequence[str], keep: str = "last",
                keys: Sequence[str] | None = (URL,), drop_null_keys: bool = True,
                ignore: Sequence[str] = ()) -> DataFrame:
    """One row per key, the first or last in ``order``.

    Without the key columns whole rows are compared, leaving out the order columns and
    ``ignore``. Kept nulls count as equal to each other. An empty text in a stored table is a
    missing value: it is dropped with the null keys.
    """
    if keys and all(k in df.columns for k in keys):
        rows = df
        if drop_null_keys:
            types = dict(df.dtypes)
            rows = df.dropna(subset=list(keys)).filter(reduce(
                lambda a, b: a & b, [F.col(k) != "" for k in keys if types[k] == "string"],
                F.lit(True)))
        return first_per_key(rows, keys, _directed(order, keep))
    whole = [c for c in df.columns if c not in order and c not in ignore]
    return first_per_key(df, whole, _directed(order, keep))


def keep_last(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return deduplicate(df, order, "last")


def keep_first(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return deduplicate(df, order, "first")


def keep_last_with_nulls(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Checkpoint rule: the newest row per URL, one row standing for all without a URL."""
    return deduplicate(df, order, "last", drop_null_keys=False)


def keep_first_by_cascade(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Earliest row by the first key set that the table has, else by the whole row."""
    keys = next((k for k in KEY_CASCADE if all(c in df.columns for c in k)), None)
    return deduplicate(df, order, "first", keys=keys, drop_null_keys=False)


def first_seen(arrivals: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first arrival of every URL; rows without a URL never count as arrivals."""
    named = arrivals.withColumn(URL, strip_blanks(F.col(URL))).filter(F.col(URL) != "")
    return first_per_key(named, [URL], _directed(order, "first"))


def skip_known(arrivals: DataFrame, known: DataFrame, order: Sequence[str]) -> DataFrame:
    """First arrivals whose URL is not in ``known``.

    Arrivals are cut to one row per URL first: the anti join then reuses their partitioning by
    URL and no hot URL reaches it. The known URLs are made distinct, which drops copies before
    their shuffle. They grow with history and so carry no broadcast hint; Spark broadcasts them
    only when their measured size allows.
    """
    known_once = known.select(URL).filter(F.col(URL).isNotNull()).distinct()
    return first_seen(arrivals, order).join(known_once, URL, "left_anti")
