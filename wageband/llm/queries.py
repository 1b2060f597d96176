"""The numbered operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.llm import (
    bpe, embeddings, html_text, lm_score, mixing, ngram_join, periodic_runs, quality, rules, search,
    suffix_dedup, token_counts, toxicity,
)
from wageband.llm.common import let, remainder, table, words_of
from wageband.llm.oracle import ORACLE_SQL  # noqa: F401  the entry module reads it from here
from wageband.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer file the contract names; it stays where its package has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.with_bpe(docs, tokenizer_path(), outputs=("n_tokens", "ids_text", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lexicon = toxicity.learn_lexicon(
        toxicity.training_rows(docs, table(spark, sf, "labels"), "toxic"))
    return toxicity.with_toxicity(docs, lexicon).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        toxicity.predicted(F.col("score")).alias("predicted"), "evidence", "n_matches")


@query
def op3_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rules.with_quality_rules(docs).drop("text", "broken_rules")


@query
def op4_ngram_join(spark, sf):
    return ngram_join.ngram_join(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op5_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.learn_quality(docs, table(spark, sf, "labels"))
    return quality.with_quality(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_suffix_dedup(spark, sf):
    return suffix_dedup.repeated_spans(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op7_lm_score(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    part = remainder(F.col("doc_id"), 10)
    return lm_score.with_lm_scores(docs.withColumn("held_out", part == 0), part != 0)


@query
def op8_html_extract(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_text.with_main_text(pages).select("page_id", "url", "text", "n_chars")


@query
def op9_embedding_dedup(spark, sf):
    return embeddings.embedding_groups(table(spark, sf, "embeddings"))


@query
def op10_pfair_mix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


@query
def op11_ranked_search(spark, sf):
    return search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


TOKEN_LIMIT = 4096


@query
def op12_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = token_counts.CountCache(shared_folder(spark, "token-cache"))
    counted = token_counts.with_token_counts(docs, tokenizer_path("piece_bpe_32k.model"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of the documents whose crc32 ends in 0 go on in a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def periodic(bound):
        words, g = bound["words"], bound["g"]
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(let(F.struct(words.alias("words"), a.alias("a"), p.alias("p")), lambda x: F.transform(
            F.sequence(F.lit(0), F.size(x["words"]) - 1),
            lambda i: F.get(x["words"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])))), " "))

    planted = let(F.struct(words_of(F.col("text")).alias("words"), F.floor(h / 10).alias("g")), periodic)
    return docs.withColumn("text", F.when(h % 10 == 0, planted).otherwise(F.col("text")))


@query
def op13_periodic_runs(spark, sf):
    docs = with_planted_runs(table(spark, sf, "documents").select("doc_id", "text"))
    found = periodic_runs.with_runs(docs).select("doc_id", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[
        r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
