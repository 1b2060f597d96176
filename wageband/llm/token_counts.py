"""Token counts through a digest cache: only contents that no run has met before are encoded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.llm.common import small_side, stored, unused, with_arrow_columns

COUNTS = "digest BINARY, n_tokens BIGINT"
# Digests that may be broadcast to pick the texts still to be encoded, some 6 MB.
MOST_BROADCAST_DIGESTS = 100_000
# A content with more than this share of the rows gets its count by broadcast: at most 1 / share do.
HOT_SHARE = 0.001


def counter_of(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts: sentencepiece for a .model file, tokenizers for a .json file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    return lambda texts: [len(e.ids) for e in coder.encode_batch(texts, add_special_tokens=False)]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file, its library and that library's version."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return hashlib.sha256(f"{library} {version(library)} {content}".encode()).hexdigest()


@dataclass(frozen=True)
class CountCache:
    """Counts by content digest below one shared folder, one part per tokenizer version.

    Each append adds a folder of its own, which counts once its job has committed. A writer that
    fails leaves nothing that is read, and writers at the same time do not meet; if both have
    counted the same content, the counts are equal and one is read.
    """

    root: str

    def _folders(self, spark: SparkSession, version: str) -> list[str]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        part = hadoop(f"{self.root}/tokenizer={version}")
        files = part.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(part):
            return []
        folders = [s.getPath() for s in files.listStatus(part)]
        return sorted(f.toString() for f in folders if files.exists(hadoop(f, "_SUCCESS")))

    def read(self, spark: SparkSession, version: str) -> DataFrame:
        """``digest`` and ``n_tokens``, one row per content."""
        folders = self._folders(spark, version)
        if not folders:
            return spark.createDataFrame([], COUNTS)
        return spark.read.schema(COUNTS).parquet(*folders).groupBy("digest").agg(
            F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, version: str) -> None:
        counts.select("digest", "n_tokens").write.parquet(
            f"{self.root}/tokenizer={version}/counts-{uuid.uuid4().hex}")


def content_digest(text: F.Column) -> F.Column:
    """Digest of the normalised content. Null reads as empty; every other character is kept, as any
    of them can change the count."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def add_missing(df: DataFrame, path: str, cache: CountCache, text: str = "text") -> int:
    """Count the contents of ``df`` that the cache lacks and append them; returns their number.

    Digests alone are compared with the cache. The text of each missing one is then taken once:
    copies fall away where they are read, before the shuffle by digest.
    """
    spark, version = df.sparkSession, tokenizer_version(path)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    contents = df.select(content_digest(content).alias("digest"), content.alias("text"))
    missing = stored(contents.select("digest").distinct().join(
        cache.read(spark, version), "digest", "left_anti"), "token-misses")
    n = missing.count()
    if n == 0:
        return 0
    few = small_side(missing, MOST_BROADCAST_DIGESTS)
    if n <= MOST_BROADCAST_DIGESTS:
        texts = contents.join(few, "digest", "left_semi").dropDuplicates(["digest"])
    else:
        texts = contents.dropDuplicates(["digest"]).join(few, "digest", "left_semi")

    def start():
        count = counter_of(path)
        return lambda batch: [count([t or "" for t in batch])]

    counted = with_arrow_columns(texts.select("digest", F.col("text").alias("n_tokens")), "n_tokens",
                                 {"n_tokens": "bigint"}, start)
    cache.append(counted, version)
    return n


def with_token_counts(df: DataFrame, path: str, cache: CountCache, text: str = "text") -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of its text, without begin, end or added special tokens.

    Contents are looked up in ``cache`` by digest, under the version of the tokenizer at ``path``;
    distinct contents that are not there are encoded whole and appended first. A null text counts
    as empty: 0 bytes, 0 tokens. Each row keeps its place and is counted alone, so ties and repeated
    rows get equal counts; an empty table gives no rows. The result columns replace input columns of
    the same name; ``text`` must not be one of them.
    """
    add_missing(df, path, cache, text)
    counts = cache.read(df.sparkSession, tokenizer_version(path))
    kept = df.drop(*[c for c in df.columns if c.lower() in ("n_bytes", "n_tokens")])
    digest, hot, key, known, number = (unused(kept, c) for c in ("_digest", "_hot", "_key", "_known", "_number"))
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = kept.withColumn(digest, content_digest(content)).withColumn(
        "n_bytes", F.octet_length(content).cast("bigint"))
    # Contents of many rows would meet in one task of the join; there are few of them.
    sizes = stored(rows.groupBy(F.col(digest).alias("digest")).agg(F.count("*").alias("n")), "token-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    frequent = sizes.where(F.col("n") > HOT_SHARE * total).select("digest")
    broadcast = F.broadcast(counts.join(F.broadcast(frequent), "digest", "left_semi").select(
        F.col("digest").alias(key), F.col("n_tokens").alias(hot)))
    marked = rows.join(broadcast, F.col(digest) == F.col(key), "left").drop(key)
    # Rows that have their count already are spread over the join's tasks, where nothing matches.
    spread = F.when(F.col(hot).isNull(), F.col(digest)).otherwise(
        F.hex(F.monotonically_increasing_id()).cast("binary"))
    joined = marked.withColumn(key, spread).join(counts.select(
        F.col("digest").alias(known), F.col("n_tokens").alias(number)), F.col(key) == F.col(known), "left")
    return joined.withColumn("n_tokens", F.coalesce(hot, number)).select(
        *[f"`{c}`" for c in kept.columns], "n_bytes", "n_tokens")
