"""URLs seen so far: runs of URL buckets with a Bloom filter each, merged as they add up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.operators.dedup import URL, first_seen
from wageband.sources import files

BUCKET = "url_bucket"
# Bits and probes of a filter per URL: about one URL in a hundred passes that is not there.
BITS_PER_URL = 10
PROBES = 7
SEED = -1


def _bits_at(hashes, size: int):
    """Places of the probes of every hash in a filter of ``size`` bits, a power of two."""
    import numpy as np

    low = hashes.astype(np.uint64)
    step = (low >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)
    return (low[:, None] + probes[None, :] * step[:, None]) & np.uint64(size - 1)


def _filter_of(table):
    """One bucket's hashes to its filter."""
    import numpy as np
    import pyarrow as pa

    hashes = table.column("hash").to_numpy()
    size = 1 << max(6, (BITS_PER_URL * len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[_bits_at(hashes, size).ravel()] = True
    return pa.table({BUCKET: table.column(BUCKET).slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()])})


def _probe(arrived, filters):
    """The runs of one bucket that may hold some of the arrived URLs."""
    import numpy as np
    import pyarrow as pa

    hits = []
    if arrived.num_rows:
        hashes = arrived.column("hash").to_numpy()
        for run, packed in zip(filters.column("run").to_pylist(), filters.column("bits").to_pylist()):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8))
            if bits[_bits_at(hashes, len(bits))].all(axis=1).any():
                hits.append(run)
    bucket = arrived.column(BUCKET)[0].as_py() if hits else 0
    return pa.table({"run": pa.array(hits, pa.string()), BUCKET: pa.array([bucket] * len(hits), pa.int32())})


@dataclass(frozen=True)
class SeenUrls:
    """Every URL noted once, in runs of micro-batches below one shared folder.

    A run holds the new URLs of one or more micro-batches, a folder per URL bucket, and a Bloom
    filter per bucket. A lookup probes the filters of the buckets its URLs fall in and reads only
    the buckets of those runs that may hold one of them. URLs are noted only if no run has them,
    so the runs need no de-duplication. Whenever ``fan_in`` runs of the same span follow one
    another they become one: a URL is rewritten once per factor of ``fan_in`` micro-batches, and
    the number of runs stays small.

    ``buckets`` should grow with the history, to some million URLs a bucket. A run counts once its
    filters are written. A micro-batch that is run again replaces its run and
    looks only at earlier ones. There is one writer at a time, as a stream has.
    """

    root: str
    buckets: int = 16
    fan_in: int = 8

    @property
    def folder(self) -> str:
        # Another number of buckets is another place: runs of both would not fit together.
        return f"{self.root}/by-{self.buckets}"

    def _run(self, first: int, last: int) -> str:
        return f"{self.folder}/run={first}..{last}"

    def _spans(self, spark: SparkSession) -> list[tuple[int, int]]:
        names = [n[4:].split("..") for n in files.names(spark, self.folder) if n.startswith("run=")]
        spans = [(int(a), int(b)) for a, b in names]
        return [s for s in spans if files.committed(spark, f"{self._run(*s)}/filters")]

    def runs(self, spark: SparkSession, before: int) -> list[tuple[int, int]]:
        """First and last micro-batch of the runs before ``before``, the longest where some overlap."""
        chosen: list[tuple[int, int]] = []
        for first, last in sorted(self._spans(spark), key=lambda s: (s[0], -s[1])):
            if last < before and (not chosen or first > chosen[-1][1]):
                chosen.append((first, last))
        return chosen

    def bucket_of(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def add(self, urls: DataFrame, batch_id: int) -> None:
        """Note URLs that no earlier run has, each once."""
        self._write(urls.select(URL), batch_id, batch_id)

    def _write(self, urls: DataFrame, first: int, last: int) -> None:
        spark, run = urls.sparkSession, self._run(first, last)
        # Replacing a run: it must not count while its URLs are being written.
        files.remove(spark, f"{run}/filters")
        urls.withColumn(BUCKET, self.bucket_of(F.col(URL))).repartition(BUCKET).write.mode(
            "overwrite").partitionBy(BUCKET).parquet(f"{run}/urls")
        hashes = spark.read.schema(f"{URL} STRING, {BUCKET} INT").parquet(f"{run}/urls").select(
            BUCKET, F.xxhash64(URL, F.lit(1)).alias("hash"))
        hashes.groupBy(BUCKET).applyInArrow(_filter_of, f"{BUCKET} INT, bits BINARY").write.mode(
            "overwrite").parquet(f"{run}/filters")

    def _folders_hit(self, urls: DataFrame, runs: Sequence[tuple[int, int]]) -> list[str]:
        """Bucket folders of the runs that may hold one of the URLs."""
        spark = urls.sparkSession
        arrived = urls.select(self.bucket_of(F.col(URL)).alias(BUCKET), F.xxhash64(URL, F.lit(1)).alias("hash"))
        touched = [r[0] for r in arrived.select(BUCKET).distinct().collect()]
        filters = reduce(DataFrame.unionByName, [
            spark.read.schema(f"{BUCKET} INT, bits BINARY").parquet(f"{self._run(*r)}/filters").select(
                F.lit(self._run(*r)).alias("run"), "bits", BUCKET) for r in runs])
        hits = arrived.groupBy(BUCKET).cogroup(
            filters.where(F.col(BUCKET).isin(touched)).groupBy(BUCKET)).applyInArrow(
            _probe, f"run STRING, {BUCKET} INT")
        return sorted(f"{h['run']}/urls/{BUCKET}={h[BUCKET]}" for h in hits.collect())

    def unseen(self, urls: DataFrame, before: int) -> DataFrame:
        """Rows whose URL no run before ``before`` has; one row per URL.

        ``urls`` is read twice, so it should be a stored table. What the driver collects has one
        entry per run and bucket.
        """
        runs = self.runs(urls.sparkSession, before)
        folders = self._folders_hit(urls, runs) if runs else []
        if not folders:
            return urls
        known = urls.sparkSession.read.schema(f"{URL} STRING").parquet(*folders)
        return urls.join(known, URL, "left_anti")

    def compact(self, spark: SparkSession, before: int) -> int:
        """Merge runs of micro-batches before ``before``; returns the number of runs left."""
        runs = self.runs(spark, before)
        while len(runs) >= self.fan_in and len({b - a for a, b in runs[-self.fan_in:]}) == 1:
            merged = runs[-self.fan_in:]
            urls = spark.read.schema(f"{URL} STRING").option("recursiveFileLookup", "true").parquet(
                *[f"{self._run(*r)}/urls" for r in merged])
            self._write(urls, merged[0][0], merged[-1][1])
            for run in merged:
                files.remove(spark, self._run(*run))
            runs = [*runs[:-self.fan_in], (merged[0][0], merged[-1][1])]
        return len(runs)


def take_new(arrivals: DataFrame, seen: SeenUrls, order: Sequence[str], batch_id: int, folder: str) -> DataFrame:
    """Write a micro-batch's first rows of new URLs to ``folder`` and note the URLs.

    The arrivals are worked out once: one row per URL is stored, then looked up.
    """
    spark = arrivals.sparkSession
    seen.compact(spark, batch_id)
    arrived, fresh = f"{folder}/arrived/batch_id={batch_id}", f"{folder}/fresh/batch_id={batch_id}"
    first_seen(arrivals, order).write.mode("overwrite").parquet(arrived)
    stored = spark.read.schema(arrivals.schema).parquet(arrived)
    seen.unseen(stored, batch_id).write.mode("overwrite").parquet(fresh)
    files.remove(spark, arrived)
    found = spark.read.schema(arrivals.schema).parquet(fresh)
    seen.add(found, batch_id)
    return found
