"""The quota run as one job: count, stop when full, skip known URLs, accept, publish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from wageband.operators.balance import quota_accept
from wageband.operators.dedup import URL
from wageband.operators.merge import POSITION
from wageband.operators.report import class_counts, targets_done
from wageband.plans.datasets import with_pay
from wageband.schemas import TARGET_PER_CLASS
from wageband.sources.tables import PublicationConflict, PublishedTables


def run_quota(tables: PublishedTables, arrivals: DataFrame, order: Sequence[str] = (POSITION,),
              target: int = TARGET_PER_CLASS, tries: int = 5) -> bool:
    """Add the arrivals that fill open quotas to the published tables; false if all are full.

    Known URLs and counts come from one published state; the new one holds its raw rows and the
    accepted ones. If another run publishes meanwhile, this one starts again from that state, so no
    quota is overfilled and no URL taken twice. ``order`` must go on beyond the positions that are
    stored.
    """
    spark = arrivals.sparkSession
    for left in reversed(range(tries)):
        now = tables.state(spark)
        counts = class_counts(now.read(spark, "training"))
        if targets_done(counts, target).first()["done"]:
            return False
        raw = now.read(spark, "raw")
        accepted = quota_accept(arrivals, with_pay(arrivals), raw.select(URL), counts, order, target)
        more = accepted.select(*[c for c in raw.columns if c in accepted.columns])
        try:
            tables.publish(raw.unionByName(more, allowMissingColumns=True), after=now.number)
            return True
        except PublicationConflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")
