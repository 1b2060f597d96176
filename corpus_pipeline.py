"""From raw documents to token ids and their texts: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wageband.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from wageband.llm.common import stored, table
from wageband.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the lexicon does not find toxic; it learns from the labelled ones."""
    lexicon = toxicity.learn_lexicon(
        toxicity.training_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    judged = toxicity.with_toxicity(docs.withColumn("t", F.col("text")), lexicon, "t")
    return judged.where(toxicity.predicted(F.col("score")) == 0).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near copies; rows without an id stay."""
    kept = ngram_join.ngram_join(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = W.partitionBy("doc_id").orderBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.join(kept, "doc_id", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return rows.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those left without words go."""
    cut = suffix_dedup.without_late_spans(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text"))
                          .otherwise(F.col("n_chars")).cast("bigint")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files and their rows follow one another."""
    ranked = mixing.mix_sources(docs)
    return ranked.repartitionByRange("mix_order").sortWithinPartitions("mix_order").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the text they decode to, its ``slot``, and ``mix_order``, which sorts the mix.

    Files are read in any order. A place follows from the rows alone, so it is worked out again here.
    """
    placed = mixing.mix_sources(docs).select("doc_id", "source", "text", "slot", "mix_order")
    return bpe.with_bpe(placed, tokenizer_path(), outputs=("n_tokens", "ids", "decoded")).select(
        "doc_id", "source", "slot", "mix_order", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix),
    ("bpe", encode),
]
# Learned weights, path searches and encoders have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
