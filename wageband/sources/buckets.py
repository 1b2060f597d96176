"""A table of one row per URL in URL buckets: a merge reads and writes the buckets it touches only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.operators.dedup import URL, deduplicate
from wageband.operators.merge import PIECE, POSITION, union_pieces
from wageband.session import stored_rows
from wageband.sources import files
from wageband.sources.tables import Manifests, Publication, PublicationConflict

BUCKET = "url_bucket"


@dataclass(frozen=True)
class BucketedTable:
    """Rows by URL below one folder, each state naming one folder per bucket that has rows.

    A new state shares the folders of untouched buckets with the one before. With more buckets than
    URLs in a merge, a merge of a small share of the URLs moves about that share of the table.
    """

    path: str
    buckets: int = 64

    @property
    def manifests(self) -> Manifests:
        # Another number of buckets is another table: their folders would not fit together.
        return Manifests(f"{self.path}/by-{self.buckets}")

    def bucket_of(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def _rows(self, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
        # Later merges may have brought further columns.
        return spark.read.option("mergeSchema", "true").parquet(*folders)

    def read(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        return self._rows(spark, sorted(self.manifests.read(spark, number).folders.values()))

    def merge(self, rows: DataFrame, keep: str = "last", order: Sequence[str] = (POSITION,),
              tries: int = 5) -> Publication:
        """Merge rows into the table: the newest row per URL stays, or with ``keep="first"`` the oldest.

        Stored rows are older than all new ones; among these ``order`` decides. Rows without a URL
        are dropped. Should another merge be published meanwhile, this one is done again on top of it.
        """
        spark = rows.sparkSession
        # One row per URL already here, so that the rows are worked out once and cut where they are read.
        new = stored_rows(deduplicate(rows, order, keep).withColumn(BUCKET, self.bucket_of(F.col(URL))),
                          "bucket-merge")
        touched = [str(r[0]) for r in new.select(BUCKET).distinct().collect()]
        for left in reversed(range(tries)):
            number = self.manifests.latest(spark)
            held = dict(self.manifests.read(spark, number).folders) if number else {}
            pieces = [new]
            if any(b in held for b in touched):
                old = self._rows(spark, [held[b] for b in touched if b in held])
                pieces = [old.withColumn(BUCKET, self.bucket_of(F.col(URL))), new]
            merged = deduplicate(union_pieces(pieces), [PIECE, *order], keep).drop(PIECE)
            folder = self.manifests.new_folder()
            merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
            written = {n.split("=")[1]: f"{folder}/{n}" for n in files.names(spark, folder) if "=" in n}
            try:
                return self.manifests.publish(spark, number + 1, {**held, **written})
            except PublicationConflict:
                if not left:
                    raise
        raise ValueError("tries must be 1 or more")
