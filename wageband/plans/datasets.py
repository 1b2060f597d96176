"""Raw postings to the proxy table and the training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.functions.features import (
    with_features, with_posting_text, with_repaired_region,
)
from wageband.functions.salary import relabel_from_salary_avg, with_salary
from wageband.functions.text import normalize_text, null_to_empty
from wageband.operators import merge
from wageband.operators.balance import cap_some_classes
from wageband.operators.dedup import URL, keep_last
from wageband.operators.ranking import with_row_id
from wageband.schemas import (
    LOW_BAND_LABELS, PROXY_COLUMNS, TARGET_COLUMN, TARGET_PER_CLASS, TRAINING_COLUMNS,
    UNKNOWN_LABEL, WAGE_BANDS, WageBand,
)
from wageband.session import stored_rows

_PASSED_ON = ["source_keyword", "scraped_at", "job_title", "company", "location", "job_url",
              "salary_text"]


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def with_pay(raw: DataFrame, bands: Sequence[WageBand] = WAGE_BANDS) -> DataFrame:
    """Salary columns only, for queries that need no features."""
    return with_salary(with_posting_text(raw), "_pay_text", bands).drop(
        "_pay_text", "_feature_text", "_n_location")


def proxy_columns(raw: DataFrame, bands: Sequence[WageBand] = WAGE_BANDS) -> DataFrame:
    """Add every derived column to raw postings, row by row; also runs on a stream."""
    enriched = with_features(with_salary(with_posting_text(raw), "_pay_text", bands))
    # Features see a null as the word nan; the stored text columns show it as empty.
    filled = {c: null_to_empty(F.col(c)) for c in _PASSED_ON if c in raw.columns}
    return enriched.withColumns(filled).drop(
        "_pay_text", "_feature_text", "_n_location", "job_description")


def build_proxy(raw: DataFrame, position: str = merge.POSITION, groups: Sequence[str] = (),
                bands: Sequence[WageBand] = WAGE_BANDS) -> DataFrame:
    """The 42-column proxy table.

    Rows are numbered after the descriptions are gone, so the numbering shuffles narrow rows; the
    blocks are counted on the raw table, so that no text is parsed for it.
    """
    numbered = with_row_id(proxy_columns(raw, bands), position, groups, counted=raw)
    return existing_columns(numbered, PROXY_COLUMNS)


def build_training_table(proxy: DataFrame) -> DataFrame:
    """The 36-column training table: labelled rows only."""
    labelled = proxy.filter((F.col("salary_available") == 1)
                            & (F.col(TARGET_COLUMN) != UNKNOWN_LABEL))
    return existing_columns(labelled, TRAINING_COLUMNS)


def labelled_rows(df: DataFrame) -> DataFrame:
    """Rows with a usable target."""
    return df.filter(F.col(TARGET_COLUMN).isNotNull()
                     & (F.lower(TARGET_COLUMN) != UNKNOWN_LABEL))


def repair_regions(df: DataFrame) -> DataFrame:
    if "location" not in df.columns:
        raise ValueError("the table has no column 'location'")
    return with_repaired_region(df)


def region_drilldown(df: DataFrame, region: str = "kalimantan") -> DataFrame:
    rows = repair_regions(df).filter(F.col("region_group") == region)
    return existing_columns(rows, ["job_title", "company", "location", "region_group"])


def candidate_label(cards: DataFrame, detail: str = "detail_text",
                    bands: Sequence[WageBand] = WAGE_BANDS) -> DataFrame:
    """Label of a card from its pay text, title, card text and detail text."""
    parts = [F.col(c) for c in ("salary_text", "job_title", "card_text", detail)
             if c in cards.columns]
    return with_salary(cards.withColumn("_card_pay", normalize_text(*parts)), "_card_pay",
                       bands).drop("_card_pay")


def low_training_table(low_raw: DataFrame, labels: Sequence[str] = LOW_BAND_LABELS) -> DataFrame:
    """Training rows of the low bands from a low-wage batch, newest per URL.

    The order column stays in the result for the union that follows.
    """
    rows = build_training_table_with_order(low_raw)
    wanted = relabel_from_salary_avg(rows).filter(F.col(TARGET_COLUMN).isin(list(labels)))
    return keep_last(wanted, [merge.POSITION])


def build_training_table_with_order(raw: DataFrame) -> DataFrame:
    """Training columns without the row number, plus the order column of the raw table."""
    enriched = proxy_columns(raw).filter(
        (F.col("salary_available") == 1) & (F.col(TARGET_COLUMN) != UNKNOWN_LABEL))
    return existing_columns(enriched, [merge.POSITION, *TRAINING_COLUMNS])


def augment_low_bands(raw: DataFrame, from_low: Column, order: Sequence[str] = (merge.POSITION,),
                      n: int = TARGET_PER_CLASS, capped: Sequence[str] = LOW_BAND_LABELS) -> DataFrame:
    """Base and low-wage raw postings in one table to the augmented training table, in one pass.

    The same rows as merging the low batch, building both training tables and uniting them:
    the newest low posting of a URL if it has pay of a low band, else the newest labelled base
    posting, then only the low bands capped. Each text is parsed once, and per URL both candidates
    come from one aggregation. ``order`` ranks rows within the base and within the low batch.
    ``raw`` is read once: the rows left are stored before the capped and the other bands part.
    """
    enriched = proxy_columns(raw.withColumn("_low", F.coalesce(from_low, F.lit(False))))
    labelled = (F.col("salary_available") == 1) & (F.col(TARGET_COLUMN) != UNKNOWN_LABEL)
    rows = relabel_from_salary_avg(enriched.withColumn("_labelled", labelled)).filter(
        (F.col(URL) != "") & (F.col("_low") | F.col("_labelled")))
    kept = [*order, *[c for c in TRAINING_COLUMNS if c in rows.columns and c not in (*order, URL)], "_labelled"]
    row, newest = F.struct(*kept), F.struct(*order)

    def latest(which: Column) -> Column:
        return F.max_by(F.when(which, row), F.when(which, newest))

    found = rows.groupBy(URL).agg(latest(F.col("_low")).alias("_new"), latest(~F.col("_low")).alias("_old"))
    usable = F.col("_new._labelled") & F.col(f"_new.{TARGET_COLUMN}").isin(list(capped))
    won = found.withColumn(merge.PIECE, F.when(usable, 1).otherwise(0)).withColumn(
        "_row", F.when(usable, F.col("_new")).otherwise(F.col("_old"))).filter("_row IS NOT NULL")
    flat = won.select(merge.PIECE, URL, "_row.*").drop("_labelled")
    columns = [merge.PIECE, *order, *[c for c in TRAINING_COLUMNS if c in flat.columns and c not in order]]
    return cap_some_classes(stored_rows(flat.select(*columns), "low-bands"), [merge.PIECE, *order], capped, n)


def add_low_bands(base: DataFrame, low: DataFrame, n: int = TARGET_PER_CLASS,
                  capped: Sequence[str] = LOW_BAND_LABELS, relabel: bool = True) -> DataFrame:
    """Base training rows plus low-wage rows: newest per URL, then only the low bands capped."""
    pieces = [relabel_from_salary_avg(p) for p in (base, low)] if relabel else [base, low]
    return cap_some_classes(merge.merge(pieces, "last"), merge.ORDER, capped, n)
