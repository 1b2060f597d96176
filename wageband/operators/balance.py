"""Caps and quotas per class or search keyword."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.operators.dedup import URL, skip_known
from wageband.operators.ranking import first_per_key, rank_within
from wageband.schemas import BAND_LABELS, JOBS_PER_KEYWORD, TARGET_COLUMN, TARGET_PER_CLASS
from wageband.session import stored_rows


def cap_classes(df: DataFrame, order: Sequence[str], n: int = TARGET_PER_CLASS,
                labels: Sequence[str] = BAND_LABELS) -> DataFrame:
    """The first n rows of every listed class; other labels are dropped."""
    listed = df.filter(F.col(TARGET_COLUMN).isin(list(labels)))
    return rank_within(listed, [TARGET_COLUMN], order, n).drop("_rank")


def cap_some_classes(df: DataFrame, order: Sequence[str], capped: Sequence[str],
                     n: int = TARGET_PER_CLASS,
                     labels: Sequence[str] = BAND_LABELS) -> DataFrame:
    """Cap only the named classes. The others pass through without a shuffle."""
    whole = [label for label in labels if label not in capped]
    return cap_classes(df, order, n, capped).unionByName(
        df.filter(F.col(TARGET_COLUMN).isin(whole)))


def quota_keys(fresh: DataFrame, counts: DataFrame, order: Sequence[str],
               target: int = TARGET_PER_CLASS) -> DataFrame:
    """Keys of the rows that fit the open quotas, in arrival order.

    ``fresh`` holds one row per new URL; ``counts`` one row per target class. No class can take
    more than ``target`` rows, which bounds both the ranking and the result.
    """
    room = counts.select(TARGET_COLUMN, (F.lit(target) - F.col("n")).alias("_room"))
    wanted = fresh.select(URL, TARGET_COLUMN, *order).join(F.broadcast(room), TARGET_COLUMN)
    ranked = rank_within(wanted.filter("_room > 0"), [TARGET_COLUMN], order, target)
    return ranked.filter("_rank <= _room").select(URL, TARGET_COLUMN, *order)


def pick_rows(arrivals: DataFrame, keys: DataFrame, order: Sequence[str]) -> DataFrame:
    """The full rows behind accepted keys, with URL and label of the key. The keys are few enough
    to broadcast."""
    return arrivals.drop(URL).join(
        F.broadcast(keys.select(*order, URL, TARGET_COLUMN)), list(order))


def quota_accept(arrivals: DataFrame, labelled: DataFrame, known: DataFrame, counts: DataFrame,
                 order: Sequence[str], target: int = TARGET_PER_CLASS) -> DataFrame:
    """New postings accepted until every class of ``counts`` has ``target`` rows.

    ``labelled`` gives the label of each arrival. Only URL, label and order travel through the
    shuffles; the accepted keys, at most ``target`` per class, then pick the full arrivals, which
    need not be parsed for that.
    """
    narrow = labelled.select(URL, TARGET_COLUMN, *order)
    keys = quota_keys(skip_known(narrow, known, order), counts, order, target)
    return pick_rows(arrivals, keys, order)


# Keywords whose heads are settled in one task: n * 64 * 65 / 2 narrow rows at most, 208,000 for n = 100.
KEYWORDS_TOGETHER = 64


def _settled(n: int):
    """Of the ranked heads of some keywords, the first n URLs per keyword that no earlier one has taken."""
    def choose(table):
        table = table.sort_by([("_keyword_no", "ascending"), ("_rank", "ascending")])
        taken, counts, kept = set(), {}, []
        for i, (number, url) in enumerate(zip(table.column("_keyword_no").to_pylist(),
                                              table.column(URL).to_pylist())):
            if url not in taken and counts.get(number, 0) < n:
                taken.add(url)
                counts[number] = counts.get(number, 0) + 1
                kept.append(i)
        return table.take(kept)

    return choose


def cap_keywords(arrivals: DataFrame, keywords: Mapping[str, int], order: Sequence[str],
                 n: int = JOBS_PER_KEYWORD, keyword: str = "source_keyword",
                 known: DataFrame | None = None, together: int = KEYWORDS_TOGETHER) -> DataFrame:
    """Up to n new URLs per search keyword, keywords worked through in their given number.

    URLs in ``known`` are never new. A URL beyond one keyword's cap stays free for a later keyword.
    Among ``together`` keywords, number j meets at most n * (j - 1) URLs taken before it, so its own
    share lies within its first n * j URLs: those bounded heads decide the result exactly, whatever
    the size of the table, and are settled in one task. More keywords follow in further blocks, which
    leave out what the blocks before have taken.
    """
    if not keywords:
        return arrivals.filter("false")
    ordinals = sorted(set(keywords.values()))
    number = F.create_map(*[F.lit(x) for pair in keywords.items() for x in pair])
    numbered = arrivals.select(URL, *order, number[F.col(keyword)].alias("_keyword_no")).filter(F.col(URL) != "")
    if known is not None:
        numbered = numbered.join(known.select(URL).filter(F.col(URL).isNotNull()).distinct(), URL, "left_anti")
    blocks = [ordinals[i:i + together] for i in range(0, len(ordinals), together)]
    picks = None
    for block in blocks:
        own = first_per_key(numbered.filter(F.col("_keyword_no").between(block[0], block[-1])),
                            ["_keyword_no", URL], [F.col(c) for c in order])
        if picks is not None:
            own = own.join(picks.select(URL), URL, "left_anti")
        place_of = F.create_map(*[F.lit(x) for i, no in enumerate(block, 1) for x in (no, i)])
        heads = rank_within(own, ["_keyword_no"], order, n * len(block)).filter(
            F.col("_rank") <= place_of[F.col("_keyword_no")] * n).withColumn("_all", F.lit(0))
        chosen = heads.groupBy("_all").applyInArrow(_settled(n), heads.schema).select(URL, *order)
        if block is not blocks[-1]:
            chosen = stored_rows(chosen, "keyword-cap")
        picks = chosen if picks is None else picks.unionByName(chosen)
    # At most n rows per keyword, named by their key and place.
    picks = picks.withColumnRenamed(URL, "_url").withColumnsRenamed({c: f"_at_{c}" for c in order})
    return arrivals.join(F.broadcast(picks), [
        arrivals[URL] == picks["_url"], *[arrivals[c] == picks[f"_at_{c}"] for c in order]], "left_semi")
