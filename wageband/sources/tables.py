"""Published tables: states that are numbered and committed whole, so what is read is never overwritten."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.functions.text import slug
from wageband.operators import merge
from wageband.operators.balance import cap_classes
from wageband.operators.ranking import with_row_id
from wageband.plans.datasets import build_proxy, build_training_table
from wageband.schemas import TARGET_PER_CLASS
from wageband.sources import files


class PublicationConflict(RuntimeError):
    """Another writer has published since the state this one started from."""


@dataclass(frozen=True)
class Publication:
    """One published state: its number and the folder of each of its tables."""

    number: int
    folders: Mapping[str, str]

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(self.folders[table])


@dataclass(frozen=True)
class Manifests:
    """Published states below one root, each a small file that names its tables' folders.

    The file of a state is written in one step and by one writer only. Tables are written to
    folders of their own before that, so a reader sees all tables of a state or none of them, and
    what a failed writer leaves behind is never read.
    """

    root: str

    def numbers(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[2:-5]) for n in files.names(spark, self.root)
                      if n.startswith("v=") and n.endswith(".json"))

    def read(self, spark: SparkSession, number: int | None = None) -> Publication:
        known = self.numbers(spark)
        if not known:
            raise FileNotFoundError(f"nothing is published below {self.root}")
        number = known[-1] if number is None else number
        named = json.loads(files.read_text(spark, f"{self.root}/v={number}.json"))
        return Publication(number, {t: f"{self.root}/{folder}" for t, folder in named.items()})

    def latest(self, spark: SparkSession) -> int:
        return max(self.numbers(spark), default=0)

    def new_folder(self) -> str:
        """A place for tables that are not published yet."""
        return f"{self.root}/data-{uuid.uuid4().hex}"

    def publish(self, spark: SparkSession, number: int, folders: Mapping[str, str]) -> Publication:
        """Make these folders state ``number``, unless another writer has taken it."""
        named = {t: folder.removeprefix(f"{self.root}/") for t, folder in folders.items()}
        if not files.write_once(spark, f"{self.root}/v={number}.json", json.dumps(named)):
            raise PublicationConflict(f"state {number} below {self.root} is another writer's")
        return Publication(number, dict(folders))

    def remove_unpublished(self, spark: SparkSession) -> int:
        """Remove folders that no state names; to be called while no writer is at work."""
        used = {folder.removeprefix(f"{self.root}/").split("/")[0]
                for n in self.numbers(spark) for folder in self.read(spark, n).folders.values()}
        left = [n for n in files.names(spark, self.root) if n.startswith("data-") and n not in used]
        for name in left:
            files.remove(spark, f"{self.root}/{name}")
        return len(left)


@dataclass(frozen=True)
class VersionedTable:
    """One table as numbered versions: a version being read is never overwritten."""

    path: str

    @property
    def _manifests(self) -> Manifests:
        return Manifests(self.path)

    def versions(self, spark: SparkSession) -> list[int]:
        return self._manifests.numbers(spark)

    def write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """Add the next version; of two writers at once, each gets a number of its own."""
        spark, folder = df.sparkSession, self._manifests.new_folder()
        df.write.partitionBy(*partition_by).parquet(folder)
        while True:
            version = self._manifests.latest(spark) + 1
            try:
                return self._manifests.publish(spark, version, {"table": folder}).number
            except PublicationConflict:
                continue

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self._manifests.read(spark, version).read(spark, "table")


def write_batch(df: DataFrame, path: str, batch: str = "batch_name") -> None:
    """Replace only the batches present in ``df``; other batches of the table stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        batch).parquet(path)


@dataclass(frozen=True)
class PublishedTable:
    """One of the tables that are published together."""

    manifests: Manifests
    name: str

    def versions(self, spark: SparkSession) -> list[int]:
        return self.manifests.numbers(spark)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self.manifests.read(spark, version).read(spark, self.name)


@dataclass(frozen=True)
class PublishedTables:
    """The raw, proxy and training tables below one root, published as one.

    Work that reads several of them should read one ``state``: its tables belong together whatever
    is published meanwhile.
    """

    root: str

    @property
    def manifests(self) -> Manifests:
        return Manifests(f"{self.root}/published")

    @property
    def raw(self) -> PublishedTable:
        return PublishedTable(self.manifests, "raw")

    @property
    def proxy(self) -> PublishedTable:
        return PublishedTable(self.manifests, "proxy")

    @property
    def training(self) -> PublishedTable:
        return PublishedTable(self.manifests, "training")

    def state(self, spark: SparkSession, number: int | None = None) -> Publication:
        return self.manifests.read(spark, number)

    def publish(self, raw: DataFrame, position: str = merge.POSITION, groups: Sequence[str] = (),
                after: int | None = None) -> Publication:
        """Write raw postings, build the two derived tables from what was written, publish all three.

        ``after`` is the number of the state that ``raw`` was made from, or 0; by default the latest
        one when the call begins. If another state has been published since then, nothing changes
        and ``PublicationConflict`` is raised.
        """
        spark = raw.sparkSession
        number = (self.manifests.latest(spark) if after is None else after) + 1
        folder = self.manifests.new_folder()
        tables = {name: f"{folder}/{name}" for name in ("raw", "proxy", "training")}
        raw.write.parquet(tables["raw"])
        build_proxy(spark.read.parquet(tables["raw"]), position, groups).write.parquet(tables["proxy"])
        build_training_table(spark.read.parquet(tables["proxy"])).write.parquet(tables["training"])
        return self.manifests.publish(spark, number, tables)

    def _batches(self, stage: str) -> str:
        return f"{self.root}/batches/{stage}"

    def publish_batch(self, name: str, raw: DataFrame, position: str = merge.POSITION) -> None:
        """Write one batch's raw, proxy and training rows; its former rows are replaced.

        Training rows are taken from the proxy rows as written, so that texts are parsed once.
        """
        def tagged(df: DataFrame) -> DataFrame:
            return df.withColumn("batch_name", slug(F.lit(name)))

        spark = raw.sparkSession
        write_batch(tagged(raw), self._batches("raw"))
        stored = spark.read.parquet(self._batches("raw")).filter(
            F.col("batch_name") == slug(F.lit(name)))
        proxy = tagged(build_proxy(stored, position))
        write_batch(proxy, self._batches("proxy"))
        written = spark.read.schema(proxy.schema).parquet(self._batches("proxy")).filter(
            F.col("batch_name") == slug(F.lit(name)))
        write_batch(tagged(build_training_table(written)), self._batches("training"))

    def publish_combined(self, spark: SparkSession) -> None:
        """Fold all batches into the combined table, the latest batch winning, and publish it.

        Positions are given anew in the order of the merge, so that later merges keep it.
        """
        batches = spark.read.parquet(self._batches("raw"))
        number = self.manifests.latest(spark)
        old = self.raw.read(spark, number) if number else None
        merged = merge.merge_batch_table(old, batches)
        order = [merge.PIECE, "_batch"]
        placed = merged.withColumn("_batch", F.coalesce("batch_name", F.lit("")))
        renumbered = with_row_id(placed.withColumnRenamed(merge.POSITION, "_pos"), "_pos", order,
                                 merge.POSITION).drop("_pos", "_batch", merge.PIECE, "batch_name")
        self.publish(renumbered, after=number)

    def balance(self, spark: SparkSession, n: int = TARGET_PER_CLASS) -> None:
        """Publish the balanced training table beside the raw and proxy tables; the full one stays."""
        now = self.state(spark)
        folder = f"{self.manifests.new_folder()}/training"
        cap_classes(now.read(spark, "training"), ["source_id"], n).write.parquet(folder)
        self.manifests.publish(spark, now.number + 1, {**now.folders, "training": folder})
