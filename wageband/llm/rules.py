"""Document quality rules: a threshold table compiled into column expressions, no user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.functions.once import with_columns_once
from wageband.llm.common import BLANKS, let, unused, words_of

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5

# Frequent function words of four languages (fixed values).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as",
    "by", "this", "are", "at", "from", "or", "an",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im",
    "dem", "nicht", "ein", "eine", "auch", "es",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui",
    "dans", "par", "sur", "au",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "al", "lo",
]


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [least, most]; asked only of documents of ``from_words`` words or more."""
    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


# The thresholds in use: wide enough that ordinary prose, lists and short notes pass.
RULES = [
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("shouting", "bang_ratio", most=0.5),
    Rule("capitals", "capital_ratio", most=0.7),
    Rule("stop_words", "stop_ratio", least=0.01, from_words=50),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("cut_lines", "ellipsis_line_ratio", most=0.5),
]


def _count(text: Column, characters: str) -> Column:
    """How often any of some ASCII characters occurs; one plain search per character."""
    total = F.lit(0).cast("bigint")
    for c in characters:
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))))
    return total


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, each word counted once.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes, inside one document.
    """
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def covered(at: Column) -> Column:
        # Windows start in rising order: each adds the words up to the next start, five at most.
        return F.aggregate(
            at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]

    def starts(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, i)["g"] == F.get(s, j)["g"], F.lit(False))

        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                          lambda i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
        return F.sort_array(F.transform(places, lambda i: F.get(s, i)["at"]))

    def of(grams: Column) -> Column:
        repeated = F.size(F.array_distinct(grams)) < F.size(grams)
        pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("at")))
        return F.when(repeated, let(F.sort_array(pairs), lambda s: covered(starts(s)))).otherwise(0)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), of))
    ).cast("bigint")


def text_measures(text: Column, words: Column, lines_name: str) -> dict[str, Column]:
    """Counts the rules are made of; ``words`` is the word array of ``text``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(text).cast("bigint") - _count(text, BLANKS),
        "n_symbols": _count(text, SYMBOLS),
        "n_bangs": _count(text, "!"),
        "n_capitals": F.regexp_count(text, F.lit("\\p{Lu}")).cast("bigint"),
        "n_letters": F.regexp_count(text, F.lit("\\p{L}")).cast("bigint"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(
            *dict.fromkeys(STOP_WORDS)))).cast("bigint"),
        lines_name: let(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
            F.size(F.filter(x, lambda y: F.trim(y, F.lit(BLANKS)).endswith("...")
                            | F.trim(y, F.lit(BLANKS)).endswith("…"))).cast("bigint").alias("cut"))),
        "n_repeat_words": repeated_words(words),
    }


def ratios() -> dict[str, Column]:
    """The metrics a rule may name, as expressions over the counts."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "bang_ratio": share("n_bangs", "n_words"),
        "capital_ratio": share("n_capitals", "n_letters"),
        "stop_ratio": share("n_stop_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": share("n_cut_lines", "n_lines"),
    }


def compile_rules(rules: list[Rule]) -> Column:
    """Names of the rules a document breaks, as one array expression."""
    metrics = ratios()
    broken = []
    for rule in rules:
        value, breaks = metrics[rule.metric], F.lit(False)
        if rule.least is not None:
            breaks = breaks | (value < rule.least)
        if rule.most is not None:
            breaks = breaks | (value > rule.most)
        asked = F.col("n_words") >= rule.from_words
        broken.append(F.when(asked & breaks, F.lit(rule.name)))
    named = F.array(*broken) if broken else F.array().cast("array<string>")
    return F.filter(named, lambda x: x.isNotNull())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs",
          "n_capitals", "n_letters", "n_stop_words", "n_lines", "n_cut_lines"]
RESULTS = [*COUNTS, "base_failed", "broken_rules", "kept"]


def with_quality_rules(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``df`` with its counts, ``base_failed``, ``broken_rules`` and ``kept``.

    ``base_failed``: fewer than 10 words, or more than 20 % of them in repeated windows. ``kept``:
    base passed and no rule broken. A null, empty or blank text has no words, so it fails. Each
    row is judged alone, so ties and repeated rows get equal verdicts, and no row is dropped.
    Result columns replace input columns of the same name; ``text`` must not be one of them.
    """
    plain = [c for c in df.columns if c.lower() not in {r.lower() for r in RESULTS}]
    rows = df.select(*[F.col(f"`{c}`") for c in plain])
    words, lines = unused(rows, "_words"), unused(rows, "_lines")
    counted = with_columns_once(
        with_columns_once(rows, {words: words_of(F.col(text))}),
        text_measures(F.col(text), F.col(words), lines))
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    judged = counted.drop(words).withColumns({
        "n_lines": F.col(f"{lines}.n"), "n_dup_lines": F.col(f"{lines}.dup"),
        "n_cut_lines": F.col(f"{lines}.cut"),
    }).withColumns({
        "base_failed": base,
        "broken_rules": compile_rules(RULES if rules is None else rules),
    }).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    return judged.select(*plain, *RESULTS)
