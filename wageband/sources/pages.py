"""Posting cards, links and detail texts from a table of fetched pages.

Python only turns one page into flat strings, the first match of each kind of selector; cleaning, the choice
of a detail section, pay snippets, de-duplication and joins are column expressions and Spark operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.functions.once import with_columns_once
from wageband.functions.text import clean_text, null_to_empty, pay_snippet, strip_blanks
from wageband.operators.dedup import URL, first_seen
from wageband.operators.ranking import first_per_key
from wageband.schemas import RAW_COLUMNS
from wageband.sources.html_tree import Element, Tree, parse

# Element tests as (tag or any, attribute, whole or part, value), tried in order.
Selector = tuple[str | None, str | None, str, str]
COMPANY_SELECTORS: list[Selector] = [
    (None, "data-automation", "whole", "jobCompany"),
    (None, "data-testid", "whole", "company-name"),
    ("span", "data-automation", "part", "company"),
    ("a", "data-automation", "part", "company"),
]
LOCATION_SELECTORS: list[Selector] = [
    (None, "data-automation", "whole", "jobLocation"),
    (None, "data-testid", "whole", "job-location"),
    ("span", "data-automation", "part", "location"),
]
SALARY_SELECTORS: list[Selector] = [
    (None, "data-automation", "whole", "jobSalary"),
    (None, "data-testid", "whole", "job-salary"),
    ("span", "data-automation", "part", "salary"),
    (None, "aria-label", "part", "salary"),
    (None, "aria-label", "part", "gaji"),
]
DETAIL_SELECTORS: list[Selector] = [
    (None, "data-automation", "whole", "jobAdDetails"),
    (None, "data-automation", "whole", "jobDescription"),
    (None, "data-testid", "whole", "job-description"),
    ("section", "data-automation", "part", "job"),
    ("main", None, "", ""),
]
# Shortest title, card text that ends the climb and its steps, detail text limits.
SHORTEST_TITLE = 3
CARD_TEXT = 180
CLIMB_STEPS = 8
DETAIL_LONGER_THAN = 100
DETAIL_LENGTH = 12_000
LINK_MARK = "/job/"
# Characters of the rows that a task holds at once, and what a row counts beside its strings.
SLICE_CHARS, ROW_CHARS = 4_000_000, 100
STAMP = "yyyy-MM-dd HH:mm:ss"


def _matches(node: Element, selector: Selector) -> bool:
    tag, attribute, how, value = selector
    if tag is not None and node.tag != tag:
        return False
    if attribute is None:
        return True
    found = node.attrs.get(attribute)
    if found is None:
        return False
    return found == value if how == "whole" else value in found


def _first_texts(tree: Tree, top: Element | None, selectors: Sequence[Selector]) -> list[str]:
    """Text of the first match of every selector below ``top`` or on the page, empty where there is none."""
    texts: dict[int, str] = {}
    by_tag = {tag for tag, attribute, _, _ in selectors if attribute is None}
    for node in tree.descendants(top):
        # Most elements have neither an attribute nor a tag that is enough.
        if not node.attrs and node.tag not in by_tag:
            continue
        for i, selector in enumerate(selectors):
            if i not in texts and _matches(node, selector):
                texts[i] = tree.text(node)
        if len(texts) == len(selectors):
            break
    return [texts.get(i, "") for i in range(len(selectors))]


def _card_of(tree: Tree, anchor: Element) -> Element | None:
    card = anchor.above("article") or anchor.above("div") or anchor
    for _ in range(CLIMB_STEPS):
        if card is None or len(tree.text(card)) >= CARD_TEXT:
            break
        card = card.above("div")
    return card


def _links(tree: Tree, base: str, mark: str) -> list[tuple[str, str, Element]]:
    """Absolute address, title and element of every posting link, first per address."""
    links: dict[str, tuple[str, str, Element]] = {}
    for node in tree.descendants():
        if node.tag != "a":
            continue
        href = node.attrs.get("href", "")
        if href and mark in href and len(tree.text(node)) >= SHORTEST_TITLE:
            try:
                url = urljoin(base, href)
            except ValueError:
                continue
            links.setdefault(url, (url, tree.text(node), node))
    return list(links.values())


# One walk over a card serves all three.
_CARD_SELECTORS = COMPANY_SELECTORS + LOCATION_SELECTORS + SALARY_SELECTORS
_LOCATIONS, _SALARIES = len(COMPANY_SELECTORS), len(COMPANY_SELECTORS + LOCATION_SELECTORS)


def _card_rows(tree: Tree, base: str, mark: str) -> Iterator[tuple]:
    picked: dict[int, tuple] = {}
    for number, (url, title, anchor) in enumerate(_links(tree, base, mark), 1):
        card = _card_of(tree, anchor)
        if id(card) not in picked:
            if card is None:
                picked[id(card)] = "", "", "", ""
            else:
                texts = _first_texts(tree, card, _CARD_SELECTORS)
                picked[id(card)] = (
                    tree.text(card), _first_of(texts[:_LOCATIONS]), _first_of(texts[_LOCATIONS:_SALARIES]),
                    _first_of(texts[_SALARIES:]))
        yield (number, url, title, *picked[id(card)])


def _first_of(texts: list[str]) -> str:
    return next(filter(None, texts), "")


def _page_rows(html: str, base: str, mark: str) -> Iterator[tuple]:
    """All that one parse of a page gives: its detail sections and text, then its cards."""
    tree = parse(html)
    yield (None, None, None, None, None, None, None, *_detail_parts(tree))
    for row in _card_rows(tree, base, mark):
        yield (*row, None, None)


def _detail_parts(tree: Tree) -> tuple[list[str], str]:
    return [t for t in _first_texts(tree, None, DETAIL_SELECTORS) if t], tree.text()


def _per_page(pages: DataFrame, rows_of: Callable[[str, str], Iterator[tuple]],
              columns: dict[str, str], base_url: str | None, keep: Sequence[str]) -> DataFrame:
    """Apply a page function to every page; ``keep`` columns are repeated on its rows.

    Rows are handed over as soon as their strings have ``SLICE_CHARS`` characters: a page gives its text once
    per card, so the rows of one batch of pages can be many times as long as the pages.
    """
    needed = list(dict.fromkeys([*keep, "url", "html"]))
    kept_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                           for f in pages.select(*keep).schema.fields)
    schema = ", ".join([kept_types, *(f"{name} {dtype}" for name, dtype in columns.items())])
    names = [*keep, *columns]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = batch[list(keep)].itertuples(index=False, name=None)
            out, chars = [], 0
            for k, url, html in zip(kept, batch["url"], batch["html"]):
                for row in rows_of(html or "", base_url or url or ""):
                    out.append((*k, *row))
                    chars += ROW_CHARS + sum(len(v) for v in row if isinstance(v, str))
                    if chars >= SLICE_CHARS:
                        yield pd.DataFrame(out, columns=names)
                        out, chars = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)

    return pages.select(*needed).mapInPandas(extract, schema)


def extract_links(pages: DataFrame, base_url: str | None = None, mark: str = LINK_MARK,
                  keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Posting links of every page with title, first per address."""
    def rows_of(html: str, base: str) -> Iterator[tuple]:
        for number, (url, title, _) in enumerate(_links(parse(html), base, mark), 1):
            yield number, url, title

    links = _per_page(pages, rows_of, {"link_no": "INT", URL: "STRING", "job_title": "STRING"},
                      base_url, keep)
    return links.withColumn("job_title", clean_text(F.col("job_title")))


def extract_cards(pages: DataFrame, base_url: str | None = None, mark: str = LINK_MARK,
                  keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Posting cards: title, company, location, pay text and whole card text."""
    cards = _per_page(pages, lambda html, base: _card_rows(parse(html), base, mark), CARD_PARTS, base_url, keep)
    return with_pay_fallback(cards.select(*keep, "link_no", URL, *_card_columns()))


# What Python gives for a card and for a page as a whole.
CARD_PARTS = {"link_no": "INT", URL: "STRING", "job_title": "STRING", "card_text": "STRING",
              "company": "STRING", "location": "STRING", "salary_text": "STRING"}
DETAIL_PARTS = {"sections": "ARRAY<STRING>", "page_text": "STRING"}


def _card_columns() -> list[Column]:
    return [clean_text(F.col(c)).alias(c) for c in ("job_title", "card_text", "company", "location", "salary_text")]


def _detail_text(most_chars: int) -> Column:
    """The first section that is long enough, else the whole page, cut to its first characters."""
    sections = F.transform(F.col("sections"), clean_text)
    long_enough = F.get(F.filter(sections, lambda t: F.length(t) > DETAIL_LONGER_THAN), F.lit(0))
    return F.substring(F.coalesce(long_enough, clean_text(F.col("page_text"))), 1, most_chars)


def with_pay_fallback(cards: DataFrame) -> DataFrame:
    """Take the pay text from the card text where no pay element was found."""
    pay = null_to_empty(F.col("salary_text"))
    return cards.withColumn(
        "salary_text", F.when(pay != "", pay).otherwise(pay_snippet(F.col("card_text"))))


def extract_details(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"),
                    most_chars: int = DETAIL_LENGTH) -> DataFrame:
    """Detail text of every page: the first long enough section, else the whole page.

    The rule keeps the first ``most_chars`` characters. A page without html has an empty text.
    """
    def rows_of(html: str, base: str) -> Iterator[tuple]:
        yield _detail_parts(parse(html))

    texts = _per_page(pages, rows_of, DETAIL_PARTS, None, keep)
    return texts.select(*keep, _detail_text(most_chars).alias("detail_text"))


def postings_of_pages(pages: DataFrame, base_url: str | None = None, mark: str = LINK_MARK,
                      most_chars: int = DETAIL_LENGTH) -> DataFrame:
    """The result of ``page_postings`` for the cards and the details of the same pages, from one parse.

    A page's cards and its detail text come out of one tree. Cards go by the address they lead to,
    details by the page's own, and one aggregation finds the first of both per address.
    """
    parts = _per_page(pages, lambda html, base: _page_rows(html, base, mark), CARD_PARTS | DETAIL_PARTS,
                      base_url, ("page_id", "url"))
    is_card = F.col("link_no").isNotNull()
    # A generator keeps the cleaning in one place, whatever is asked of its columns.
    cleaned = with_columns_once(parts, {
        "address": F.when(is_card, strip_blanks(F.col(URL))).otherwise(F.col("url")),
        "card": F.when(is_card, F.struct("page_id", "link_no", *_card_columns())),
        "detail": F.when(~is_card, _detail_text(most_chars))}).filter("address <> ''")
    found = cleaned.groupBy(F.col("address").alias(URL)).agg(
        F.min_by("card", F.when(F.col("card").isNotNull(), F.struct("page_id", "link_no"))).alias("card"),
        F.min_by("detail", F.when(F.col("card").isNull(), F.col("page_id"))).alias("detail_text"))
    listed = with_pay_fallback(found.filter("card IS NOT NULL").select(URL, "card.*", "detail_text"))
    return listed.select("page_id", "link_no", URL, "job_title", "card_text", "company", "location", "salary_text",
                         "detail_text", clean_text(F.concat_ws(" ", "card_text", "detail_text")).alias("job_description"))


def page_postings(listing: DataFrame, details: DataFrame, order: Sequence[str]) -> DataFrame:
    """Raw postings from cards and the fetched detail pages, first card per address.

    A card whose detail page was not fetched keeps its card text as description. Both sides are
    cut to one row per address before they are joined by it.
    """
    one_detail = first_per_key(
        details.select(F.col("url").alias(URL), "page_id", "detail_text"), [URL],
        [F.col("page_id")]).select(URL, "detail_text")
    joined = first_seen(listing, order).join(one_detail, URL, "left")
    return joined.withColumn("job_description", clean_text(
        F.concat_ws(" ", "card_text", "detail_text")))


def to_raw(found: DataFrame) -> DataFrame:
    """The eight raw columns, stamped with the time of this run."""
    stamped = found.withColumn("scraped_at", F.date_format(F.current_timestamp(), STAMP))
    if "source_keyword" not in stamped.columns:
        stamped = stamped.withColumn("source_keyword", F.lit(""))
    return stamped.select(*RAW_COLUMNS)
