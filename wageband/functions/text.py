"""Text scalars as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wageband.functions import vocab

# The 29 code points that count as white space, first without the plain blank.
_OTHER_BLANKS = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ANY_BLANK = rf"[ {_OTHER_BLANKS}]"
_OTHER_BLANK_CHARS = "".join(map(chr, [
    *range(0x09, 0x0e), *range(0x1c, 0x20), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f,
    0x205f, 0x3000]))
# Most texts hold no white space but lone plain blanks. One cheap class, which takes in all
# printable characters below the first exotic blank, tells them from the rest. Alternatives or a look
# ahead in one pattern would take forty times as long as these tests one by one.
_UNUSUAL = r"[^ -~\u00a1-\u167f]"


def collapse_blanks(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at either end."""
    plain = F.translate(text, _OTHER_BLANK_CHARS, " " * len(_OTHER_BLANK_CHARS))
    needs_work = F.contains(text, F.lit("  ")) | text.rlike(_UNUSUAL)
    return F.trim(F.when(needs_work, F.regexp_replace(plain, "  +", " ")).otherwise(text))


def normalize_text(*parts: Column) -> Column:
    """Join the non-null parts, lower the case and collapse white space."""
    return collapse_blanks(F.lower(F.concat_ws(" ", *parts)))


def clean_text(text: Column) -> Column:
    """Collapse white space and keep the case; null becomes the empty string."""
    return F.coalesce(collapse_blanks(text), F.lit(""))


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_ANY_BLANK}+|{_ANY_BLANK}+$", "")


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def shortest_keywords(keywords: Sequence[str]) -> list[str]:
    """Leave out a keyword that contains another one: the shorter already decides the test."""
    return [k for k in keywords if not any(o != k and o in k for o in keywords)]


def mentions_any(text: Column | str, keywords: Sequence[str]) -> Column:
    """Whether any keyword occurs in the text. A column name is quicker to plan than a column:
    the whole test is then handed over as one expression."""
    words = shortest_keywords(keywords)
    if isinstance(text, str):
        return F.expr(" OR ".join(f"contains(`{text}`, {_sql_text(w)})" for w in words))
    return reduce(or_, [text.contains(w) for w in words])


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains_any(text: Column | str, keywords: Sequence[str]) -> Column:
    """1 when any keyword occurs as a substring, else 0."""
    return mentions_any(text, keywords).cast("int")


def first_match(text: Column | str, rules: Sequence[tuple[str, Sequence[str]]],
                default: Column) -> Column:
    """Label of the first rule with a keyword in the text."""
    (label, keywords), *rest = rules
    case = F.when(mentions_any(text, keywords), F.lit(label))
    for label, keywords in rest:
        case = case.when(mentions_any(text, keywords), F.lit(label))
    return case.otherwise(default)


def _first_gpa(text: Column, pattern: str) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    # No hit is the empty string, which is not a number, so the cast makes it null.
    value = F.replace(hit, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(0, 4), value)


def min_gpa(text: Column) -> Column:
    """Required grade point average in normalised text, or null."""
    ipk, gpa, minimum_gpa = vocab.GPA_PATTERNS
    # The substring tests keep the pattern engine away from texts that cannot match.
    return F.coalesce(
        F.when(text.contains("ipk"), _first_gpa(text, ipk)),
        F.when(text.contains("gpa"),
               F.coalesce(_first_gpa(text, gpa), _first_gpa(text, minimum_gpa))),
    )


def experience_years(text: Column) -> Column:
    """Smallest number of years of experience asked for in normalised text, 0 if none."""
    hits = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1))
                      for p in vocab.EXPERIENCE_PATTERNS])
    # A number beyond the type's range is still the number of years asked for: the largest one.
    years = F.array_min(F.transform(hits, lambda h: F.coalesce(
        h.try_cast("int"), F.when(h != "", F.lit(2 ** 31 - 1)))))
    worth_a_scan = mentions_any(text, ["pengalaman", "experience"]) & mentions_any(
        text, ["tahun", "thn", "year"])
    return F.coalesce(F.when(worth_a_scan, years), F.lit(0))


def slug(text: Column) -> Column:
    """File-safe name: lower case, other characters to single underscores."""
    lowered = F.lower(strip_blanks(text))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _snippet_of(words: Column) -> Column:
    marked = F.filter(
        F.transform(words, lambda w, i: F.when(
            mentions_any(F.lower(w), vocab.SNIPPET_MARKERS), i)),
        lambda i: i.isNotNull(),
    )

    def window(i: Column) -> Column:
        start = F.greatest(i - vocab.SNIPPET_WORDS_BEFORE, F.lit(0))
        end = F.least(i + vocab.SNIPPET_WORDS_AFTER, F.size(words))
        return F.array_join(F.slice(words, start + 1, end - start), " ")

    return F.array_join(
        F.transform(F.slice(marked, 1, vocab.SNIPPET_CHUNKS), window), " | ")


def pay_snippet(text: Column) -> Column:
    """Words around the first tokens that mention money, in the original case."""
    # The one-element array lets the lambda name the words, so that they are split only once.
    words = F.array(F.split(clean_text(text), " "))
    snippet = F.get(F.transform(words, _snippet_of), F.lit(0))
    return F.when(mentions_any(F.lower(text), vocab.SNIPPET_MARKERS), snippet).otherwise("")
