"""Resumable ingest: quota acceptance and running counts on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from wageband.operators.balance import pick_rows, quota_keys
from wageband.operators.dedup import URL
from wageband.operators.merge import POSITION
from wageband.operators.report import targets_done
from wageband.plans.datasets import with_pay
from wageband.schemas import TARGET_COLUMN, TARGET_PER_CLASS
from wageband.sources import files
from wageband.streaming.seen import SEED, SeenUrls, take_new

# How often a running stream is asked whether it has filled the quotas.
_POLL_SECONDS = 0.2


def read_arrivals(spark: SparkSession, path: str, schema: T.StructType,
                  files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive; ``files_per_trigger`` sets how often progress is saved."""
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_trigger).parquet(path)


@dataclass(frozen=True)
class Ledger:
    """Seen URLs, accepted rows and rows per class below one shared folder.

    A micro-batch that is run again replaces its own folders and looks only at earlier ones, so
    a restart gives the same result. A micro-batch reads the URL buckets that its arrivals may be
    in and the counts that the one before it left, whatever the length of the history.
    """

    root: str
    order: Sequence[str] = (POSITION,)

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch_id={batch_id}"

    @property
    def seen(self) -> SeenUrls:
        return SeenUrls(f"{self.root}/seen")

    def seed(self, known: DataFrame, counts: DataFrame) -> None:
        """Start from the URLs and class counts of the tables that exist already."""
        self.seen.add(known.select(URL).filter(F.col(URL).isNotNull()).distinct(), SEED)
        counts.select(TARGET_COLUMN, "n").write.mode("overwrite").parquet(self._folder("counts", SEED))

    def accepted(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Accepted rows of raw ``schema`` with their label."""
        with_batch = T.StructType(schema.fields + [
            T.StructField(TARGET_COLUMN, T.StringType()), T.StructField("batch_id", T.LongType())])
        if not files.exists(spark, f"{self.root}/accepted"):
            return spark.createDataFrame([], with_batch)
        return spark.read.schema(with_batch).parquet(f"{self.root}/accepted")

    def counts(self, spark: SparkSession, before: int) -> DataFrame:
        """Rows per target class as the last micro-batch before ``before`` left them."""
        written = [int(n.split("=")[1]) for n in files.names(spark, f"{self.root}/counts") if "=" in n]
        latest = max(b for b in written if b < before and files.committed(spark, self._folder("counts", b)))
        return spark.read.schema(f"{TARGET_COLUMN} STRING, n BIGINT").parquet(self._folder("counts", latest))

    def full(self, spark: SparkSession, target: int, before: int = 1 << 62) -> bool:
        """Whether every class has ``target`` rows."""
        return bool(targets_done(self.counts(spark, before), target).first()["done"])

    def take(self, arrivals: DataFrame, batch_id: int, target: int) -> None:
        """One micro-batch of raw postings: note every new URL, accept what fits the quotas.

        URL and order alone tell which rows are new; only these are parsed for their label. The
        accepted keys, at most ``target`` per class, pick the full rows from the arrivals in a
        broadcast join. Once all classes are full, a micro-batch reads nothing and leaves nothing.
        """
        spark = arrivals.sparkSession
        if self.full(spark, target, batch_id):
            return
        before = self.counts(spark, batch_id)
        fresh = take_new(arrivals.select(URL, *self.order), self.seen, self.order, batch_id, self.root)
        labelled = with_pay(arrivals.drop(URL).join(fresh, list(self.order)))
        keys = quota_keys(labelled, before, self.order, target)
        pick_rows(arrivals, keys, self.order).write.mode("overwrite").parquet(
            self._folder("accepted", batch_id))
        taken = spark.read.schema(f"{TARGET_COLUMN} STRING").parquet(self._folder("accepted", batch_id))
        before.unionByName(taken.groupBy(TARGET_COLUMN).agg(F.count(F.lit(1)).alias("n"))).groupBy(
            TARGET_COLUMN).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(
            self._folder("counts", batch_id))


def ingest_with_quota(arrivals: DataFrame, ledger: Ledger,
                      target: int = TARGET_PER_CLASS) -> StreamingQuery:
    """Take all raw arrivals that are there now; call again to go on where it stopped."""
    return (
        arrivals.writeStream.foreachBatch(lambda df, n: ledger.take(df, n, target))
        .option("checkpointLocation", f"{ledger.root}/progress")
        .trigger(availableNow=True).start()
    )


def quotas_full(ledger: Ledger, spark: SparkSession, target: int = TARGET_PER_CLASS) -> bool:
    """Whether further runs can accept anything."""
    return ledger.full(spark, target)


def fill_quotas(arrivals: DataFrame, ledger: Ledger, target: int = TARGET_PER_CLASS,
                available_now: bool = True) -> bool:
    """Take raw arrivals until every class is full; true if it is.

    The stream is stopped once the micro-batch that fills the last class has been committed, also
    if more arrivals wait, or keep coming without ``available_now``. A call with full quotas starts
    no stream.
    """
    spark = arrivals.sparkSession
    if ledger.full(spark, target):
        return True
    filled: list[int] = []

    def step(rows: DataFrame, batch_id: int) -> None:
        if not filled:
            ledger.take(rows, batch_id, target)
            if ledger.full(spark, target):
                filled.append(batch_id)

    trigger = {"availableNow": True} if available_now else {"processingTime": "0 seconds"}
    query = (arrivals.writeStream.foreachBatch(step)
             .option("checkpointLocation", f"{ledger.root}/progress").trigger(**trigger).start())
    while not query.awaitTermination(_POLL_SECONDS):
        if filled and (query.lastProgress or {}).get("batchId", -1) >= filled[0]:
            query.stop()
    return bool(filled)


def ingest_new(arrivals: DataFrame, seen: SeenUrls, root: str, order: Sequence[str] = (POSITION,)) -> StreamingQuery:
    """Write the first row of every URL that is new, as arrivals come in, to ``root/fresh``."""
    return (
        arrivals.writeStream.foreachBatch(lambda df, n: take_new(df, seen, order, n, root) and None)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).start()
    )


def new_urls(arrivals: DataFrame) -> DataFrame:
    """First sighting of every URL across restarts, kept in the state of the query."""
    return arrivals.filter(F.col(URL).isNotNull()).select(URL).dropDuplicates([URL])


def append_to(stream: DataFrame, root: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/progress").outputMode("append")
        .trigger(availableNow=True).start()
    )


def running_counts(arrivals: DataFrame, root: str) -> StreamingQuery:
    """Rows per label so far, one small folder per micro-batch."""
    def write(counts: DataFrame, batch_id: int) -> None:
        counts.write.mode("overwrite").parquet(f"{root}/counts/batch_id={batch_id}")

    return (
        arrivals.groupBy(TARGET_COLUMN).agg(F.count(F.lit(1)).alias("n"))
        .writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, root: str) -> DataFrame:
    counts = spark.read.parquet(f"{root}/counts")
    latest = counts.agg(F.max("batch_id").alias("batch_id"))
    return counts.join(F.broadcast(latest), "batch_id", "left_semi").select(TARGET_COLUMN, "n")
