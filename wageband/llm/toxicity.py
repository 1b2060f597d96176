"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding lowers the text, turns look-alike letters of other scripts into Latin ones, drops
invisible characters, reads digits and signs inside a word as the letters they stand for, and
turns all else into single blanks. The lexicon holds word beginnings and whole words with a weight
each: how much more often toxic texts have them than others. Exception phrases take the matches
inside them away. The evidence of a text is the summed weight of its matches by its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.llm.common import remainder, with_arrow_columns

# Letters that look like Latin ones (fixed values).
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ѵ": "v", "ԛ": "q",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
INVISIBLE = "­​‌‍⁠﻿"
# Ordinary phrases whose words are insults elsewhere.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bag", "trash bags", "trash bin", "clown fish",
    "clown car", "circus clown", "disgusting smell", "worthless stock", "pond scum",
    "soap scum", "sore loser",
)
TRAIN_ROWS = 8_000
LONGEST_STEM, SHORTEST_STEM = 12, 3
LEAST_TEXTS = 3
LEAST_WEIGHT = 2.5
MOST_ENTRIES = 5_000
# Texts shorter than this many words count as this long.
FEW_WORDS = 40


class Folder:
    """Folds texts; one regular expression and one translation table."""

    def __init__(self):
        table: dict[int, str | None] = {ord(k): v for k, v in HOMOGLYPHS.items()}
        table |= {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
        table |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
        table |= {ord(c): None for c in INVISIBLE}
        self.letters = table
        self.digits = str.maketrans(DIGITS)
        self.digit = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[^\W\d_])")
        self.sign = re.compile(r"(?<=[^\W\d_])[@$!|+]+(?=[^\W\d_])")
        self.other = re.compile(r"[\W_]+")
        self.signs = str.maketrans(SIGNS)

    def fold(self, text: str) -> str:
        """Words between single blanks, with a blank at both ends."""
        if not text.isascii():
            text = text.translate(self.letters)
        # Digits beside letters stand for letters; a number of its own stays one.
        text = self.digit.sub(lambda m: m.group().translate(self.digits), text.lower())
        text = self.sign.sub(lambda m: m.group().translate(self.signs), text)
        return " " + self.other.sub(" ", text).strip() + " "


@dataclass
class Lexicon:
    """Weights of patterns (`` word`` begins with, `` word `` is), exceptions, and the curve to a score."""
    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    curve: tuple[float, float] = (-3.0, 1.0)
    automaton: object = field(default=None, repr=False)

    def build(self) -> Lexicon:
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        if len(found):
            found.make_automaton()
        return Lexicon(self.weights, self.exceptions, self.curve, found)

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the matches that no exception covers, the longest per word."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, int, float]] = {}
        free: list[tuple[int, int]] = []
        for last, (length, weight) in self.automaton.iter(folded):
            start = last + 1 - length
            if weight is None:
                free.append((start, last + 1))
            elif start not in best or best[start][1] < last + 1:
                best[start] = (start, last + 1, weight)
        free.sort()
        starts = [a for a, _ in free]
        reach = list(accumulate((b for _, b in free), max))  # how far the exceptions up to each one go
        return sorted(m for m in best.values()
                      if not (k := bisect_right(starts, m[0])) or reach[k - 1] < m[1])

    def evidence(self, folded: str) -> tuple[float, int]:
        """Summed weight by the root of the length in words, and the number of matches."""
        found = self.matches(folded)
        words = max(FEW_WORDS, folded.count(" ") - 1)
        return sum(w for _, _, w in found) / math.sqrt(words), len(found)

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(evidence)))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id",
                  rows: int = TRAIN_ROWS, parts: int = 5) -> DataFrame:
    """At most ``rows`` labelled texts outside the held-out part, the first by the MD5 of the key.

    Text and label only. The chosen keys are at most ``rows`` long, so they are broadcast and no
    text is shuffled. Labels that are null, or whose key is null or has two different labels, are
    left out.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).where(
        remainder(F.col(key), parts) != 0).groupBy(key).agg(
        F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most").orderBy(
        F.md5(F.col(key).cast("string").cast("binary")), key).limit(rows).select(
        F.col(key).alias("_key"), F.col("label").cast("int").alias("label"))
    return docs.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "_key").select("text", "label")


def learn_lexicon(train: DataFrame, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """A lexicon from rows of (text, label): bounded by the caller, see ``training_rows``.

    Every text counts a pattern once. Patterns are word beginnings of 3 to 12 letters and whole
    words; of those that begin alike the longest is kept that loses at most 5 % of the toxic
    texts. Only patterns in three toxic texts or more whose weight is 2.5 or more leave the cluster.
    With no toxic or no clean texts the lexicon is empty.
    """
    def forms(batches):
        import pyarrow as pa

        folder = Folder()
        for batch in batches:
            rows: list[str] = []
            marks: list[int] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = set()
                for word in set(folder.fold(text).split()):
                    seen.add(f" {word} ")
                    seen.update(f" {word[:n]}" for n in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1))
                rows.extend(seen)
                marks.extend([label] * len(seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.string()), pa.array(marks, pa.int32())], names=["form", "label"])

    sizes = train.groupBy("label").count().collect()
    texts = {r["label"]: r["count"] for r in sizes}
    toxic, clean = texts.get(1, 0), texts.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, exceptions, (-30.0 if not toxic else 30.0, 0.0))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    counted = train.mapInArrow(forms, "form STRING, label INT").groupBy("form").agg(
        F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    found = counted.where(F.col("t") >= LEAST_TEXTS).withColumn("w", weight).where(
        F.col("w") >= LEAST_WEIGHT).orderBy((F.col("w") * F.col("t")).desc(), "form").limit(
        MOST_ENTRIES).collect()
    lexicon = Lexicon(_longest_equal({r["form"]: (r["t"], r["w"]) for r in found}), exceptions)
    return Lexicon(lexicon.weights, exceptions, _fit_curve(train, lexicon))


def _longest_equal(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Of patterns that begin alike, the longest with nearly all the texts of the shorter."""
    kept: dict[str, float] = {}
    below: dict[str, list[str]] = {}
    for form in found:
        below.setdefault(form[:-1], []).append(form)
    for form, (t, w) in found.items():
        longer = [f for f in below.get(form, ()) if found[f][0] >= 0.95 * t]
        if not longer:
            kept[form] = w
    # A pattern says nothing more where a shorter one is kept with as much weight.
    return {f: w for f, w in kept.items()
            if not any(kept.get(f[:n], -1.0) >= w for n in range(1 + SHORTEST_STEM, len(f)))}


def _fit_curve(train: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Logistic curve from evidence to the label, by Newton steps on the bounded training rows."""
    import numpy as np

    rows = with_toxicity(train, lexicon, "text").select("evidence", "label").toPandas()
    x, y = np.log1p(rows["evidence"].to_numpy(float)), rows["label"].to_numpy(float)
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        # A small penalty keeps the curve finite where the evidence parts the labels wholly.
        slope = design.T @ (y - p) - 0.01 * beta
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def with_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``df`` with ``evidence``, ``n_matches`` and ``score``, by the text alone.

    The lexicon has at most 5,000 entries and travels with the job. A null, empty or unmatched
    text has no evidence and gets the curve's lowest score. Rows are judged one by one, so repeated
    rows get equal scores and none is dropped; texts are read whole. Result columns replace input
    columns of the same name.
    """
    def start():
        folder, ready = Folder(), lexicon.build()

        def judge(texts):
            found = [ready.evidence(folder.fold(t)) if t else (0.0, 0) for t in texts]
            return ([e for e, _ in found], [n for _, n in found],
                    [ready.score(e) for e, _ in found])

        return judge

    return with_arrow_columns(
        df, text, {"evidence": "DOUBLE", "n_matches": "BIGINT", "score": "DOUBLE"}, start)


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")
