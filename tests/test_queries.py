import os

import pytest

import __spark_entry__ as entry
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, entry.queries()[name], entry.oracle_sql()[name], SF)[0] == "ok"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 8


def test_pages_cover_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert entry.queries()["page_text"](spark, SF).count() == pages
    cards = entry.queries()["page_cards"](spark, SF)
    links = entry.queries()["page_links"](spark, SF)
    assert cards.select("page_id", "job_url", "job_title").exceptAll(
        links.select("page_id", "job_url", "job_title")).count() == 0
    assert cards.count() == links.count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_low_bands_read_the_postings_once(spark, monkeypatch):
    from wageband.plans import datasets

    passed = []
    monkeypatch.setattr(datasets, "stored_rows", lambda df, purpose: passed.append(df) or df)
    entry.queries()["low_band_augment"](spark, SF)
    plan = _plan(passed[0])
    assert plan.count("FileScan") == 2 and plan.count("orders.parquet") == 1


def test_pages_are_parsed_once(spark):
    assert _plan(entry.queries()["page_postings"](spark, SF)).count("MapInPandas") == 1
    assert _plan(entry.queries()["page_postings_joined"](spark, SF)).count("MapInPandas") == 2
