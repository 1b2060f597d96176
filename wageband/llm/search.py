"""Ranked lexical search: best-first document intervals, bounded by range maxima of posting lists."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from wageband.llm.common import stored, with_arrow_columns

K = 10
# Characters of item texts searched for at once: the driver and each task hold the terms of one block.
BLOCK_CHARS = 1_000_000
# Postings in a shard, which one task holds with its sparse tables (about 80 bytes a posting).
SHARD_POSTINGS = 1_000_000
# Shards whose best documents are ranked together before an item's are.
SHARD_GROUP = 256
# Intervals split in one step, at most.
MOST_SPLITS = 512

# Bytes of a term stay, A-Z in lower case; other ASCII bytes part terms.
_TERM_BYTES = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def _counter(vocabulary: dict[bytes, int]):
    """Per text: its number of terms, and number and count of each term of the vocabulary."""
    def start():
        def of(texts):
            sizes, numbers, counts = [], [], []
            for text in texts:
                terms = terms_of(text)
                known = Counter(map(vocabulary.get, terms))
                known.pop(None, None)
                sizes.append(len(terms))
                numbers.append(list(known))
                counts.append(list(known.values()))
            return [sizes, numbers, counts]

        return of

    return start


class Shard:
    """Posting lists of some documents, each with a sparse table of its range maxima.

    Documents are numbered in the order that ranks equal scores. The lists lie one after another in
    flat arrays. Level j of the table has, for each place, the place of the greatest impact among
    the 2^j postings from there on; ranges are only ever asked for within one list.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int):
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = docs[order], impacts[order]
        self.n_docs = n_docs
        self.keys = terms[order].astype(np.int64) * n_docs + self.docs
        self.starts = np.searchsorted(self.keys, np.arange(n_terms + 1, dtype=np.int64) * n_docs)
        longest = int(np.diff(self.starts).max(initial=0))
        self.log2 = np.zeros(longest + 1, np.int64)
        for size in range(2, longest + 1):
            self.log2[size] = self.log2[size >> 1] + 1
        levels = [np.arange(len(self.keys), dtype=np.int32)]
        while 2 << (len(levels) - 1) <= longest:
            half, below = 1 << (len(levels) - 1), levels[-1]
            left, right = below[:len(below) - half], below[half:]
            levels.append(np.where(self.impacts[left] >= self.impacts[right], left, right))
        self.offsets = np.cumsum([0] + [len(level) for level in levels[:-1]])
        self.table = np.concatenate(levels)

    def _bounds(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per interval (row): the sum of its lists' greatest impacts, and the document to split it at."""
        size = last - first
        some = size > 0
        level = self.log2[np.where(some, size, 0)]
        offset = self.offsets[level]
        a = self.table[offset + np.where(some, first, 0)]
        b = self.table[offset + np.where(some, last - (1 << level), 0)]
        place = np.where(self.impacts[a] >= self.impacts[b], a, b)
        best = np.where(some, self.impacts[place], 0)
        rows = np.arange(len(best))
        return best.sum(axis=1), self.docs[place[rows, best.argmax(axis=1)]]

    def best(self, terms: Sequence[int], k: int) -> list[tuple[int, int]]:
        """The k documents with the highest scores above 0, as (score, document), best first.

        The interval with the highest bound is split at its document of greatest impact, which is
        scored, and both sides get bounds of their own, until no bound can reach the k-th score. A
        few of the best intervals, more with each step, are split at once in one array operation.
        """
        terms = np.array([t for t in terms if self.starts[t] < self.starts[t + 1]], np.int64)
        if not len(terms):
            return []
        first, last = self.starts[terms][None, :], self.starts[terms + 1][None, :]
        low = np.zeros(1, np.int64)
        bound, split = self._bounds(first, last)
        top_score, top_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = 4
        while True:
            alive = bound > 0
            if len(top_score) == k:
                least, at = top_score[-1], top_doc[-1]
                alive &= (bound > least) | ((bound == least) & (low < at))
            if not alive.any():
                break
            if not alive.all():
                first, last, low, bound, split = first[alive], last[alive], low[alive], bound[alive], split[alive]
            if len(bound) > step:
                rank = np.argpartition(-bound, step)
                now, rest = rank[:step], rank[step:]
            else:
                now, rest = np.arange(len(bound)), np.zeros(0, np.int64)
            a, b, doc = first[now], last[now], split[now]
            place = np.searchsorted(self.keys, terms[None, :] * self.n_docs + doc[:, None])
            inside = np.where(place < b, place, 0)
            hit = (place < b) & (self.docs[inside] == doc[:, None])
            score = np.where(hit, self.impacts[inside], 0).sum(axis=1)
            all_scores, all_docs = np.concatenate([top_score, score]), np.concatenate([top_doc, doc])
            ranked = np.lexsort((all_docs, -all_scores))[:k]
            top_score, top_doc = all_scores[ranked], all_docs[ranked]
            new_first = np.concatenate([a, np.where(hit, place + 1, place)])
            new_last = np.concatenate([place, b])
            new_bound, new_split = self._bounds(new_first, new_last)
            first, last = np.concatenate([first[rest], new_first]), np.concatenate([last[rest], new_last])
            low = np.concatenate([low[rest], low[now], doc + 1])
            bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])
            step = min(2 * step, MOST_SPLITS)
        return [(int(s), int(d)) for s, d in zip(top_score, top_doc) if s > 0]


def shard_of(sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray,
             weights: np.ndarray, n_docs: int, n_terms: int) -> Shard:
    """A shard of documents in order: their terms in all, and number and counts of their postings.

    ``n_docs`` and ``n_terms`` (N and L) are those of the whole table.
    """
    norm = np.array([10 + (90 * int(n) * n_docs) // n_terms for n in sizes], np.int64)
    docs = np.repeat(np.arange(len(sizes), dtype=np.int64), lengths)
    counts = counts.astype(np.int64)
    impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * norm[docs]))
    useful = impacts > 0
    return Shard(terms[useful], docs[useful], impacts[useful], len(weights), len(sizes))


def _blocks(items: DataFrame, item_id: str, text: str):
    """Distinct items in blocks that are small enough for the driver and for a task."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where(
        "text IS NOT NULL").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for block in range(n):
        yield rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block).collect()


def _searched(docs: DataFrame, block: list, item_type, k: int) -> DataFrame | None:
    """The best documents of each shard for the items of a block; None if no item has terms."""
    asked = [(row["item"], sorted(set(terms_of(row["text"])))) for row in block]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in asked for t in ts}))}
    if not vocabulary:
        return None
    ids, queries = [i for i, _ in asked], [[vocabulary[t] for t in ts] for _, ts in asked]

    counted = stored(with_arrow_columns(docs, "terms", {
        "n": "bigint", "terms": "array<int>", "counts": "array<int>"}, _counter(vocabulary)).where("n > 0"),
        "search-postings")
    n_docs, n_terms, n_postings = counted.agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    frequent = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequent.get(t, 0) + 1)))
                        for t in range(len(vocabulary))], np.int64)
    n_shards = max(1, -(-n_postings // SHARD_POSTINGS))

    schema = StructType.fromDDL("item_no INT, shard BIGINT, score BIGINT").add("item_id", item_type).add(
        "doc_id", docs.schema["doc"].dataType)

    def search(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        table = table.sort_by([("doc", "ascending")]).combine_chunks()
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        shard = shard_of(table.column("n").to_numpy(), terms.value_lengths().to_numpy(),
                         terms.flatten().to_numpy(), counts.flatten().to_numpy(), weights, n_docs, n_terms)
        found = [(no, score, doc) for no, asked in enumerate(queries) for score, doc in shard.best(asked, k)]
        return pa.table([
            pa.array([no for no, _, _ in found], pa.int32()),
            pa.array([table.column("shard")[0].as_py()] * len(found), pa.int64()),
            pa.array([score for _, score, _ in found], pa.int64()),
            pa.array([ids[no] for no, _, _ in found], to_arrow_type(schema["item_id"].dataType)),
            table.column("doc").take(pa.array([doc for _, _, doc in found], pa.int64())),
        ], names=schema.names)

    rows = counted.where(F.size("terms") > 0).withColumn(
        "shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)))
    return rows.repartition(int(n_shards), "shard").groupBy("shard").applyInArrow(search, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k highest-scoring documents of every item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. With N
    documents of at least one term, L terms in all, n in the document, df documents holding a term
    and tf of it in the document, the weight is w = floor(1000 * ln((2N + 2) / (2df + 1))), the
    norm m = 10 + (90 * n * N) div L, and the score sums w * ((10^9 * tf) div (1000 * tf + 8 * m))
    over the item's distinct terms. Only scores above 0 count; equal ones go by rising ``doc_id``,
    null last.

    Each row of ``docs`` is a document of its own, also if rows share an id or a text; a null,
    empty or blank text has no terms. Items equal in id and text are one item; items that share an
    id but not the text are each answered. An item without terms or matches, or with a null text,
    has no rows. An empty table gives no rows. Other columns play no part.

    Items are searched for in blocks of ``BLOCK_CHARS`` characters (or one longer text): only their
    terms get posting lists. Documents are dealt over shards by row, so copies and hot sources
    spread, and each shard's best k meet in two rankings.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("terms")).withColumn(
        "row", F.monotonically_increasing_id())
    item_type = items.schema[item_id].dataType
    answers = []
    for block in _blocks(items, item_id, item_text):
        found = _searched(rows, block, item_type, k)
        if found is not None:
            order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
            near = Window.partitionBy("item_no", F.floor(F.col("shard") / SHARD_GROUP)).orderBy(*order)
            whole = Window.partitionBy("item_no").orderBy(*order)
            near_best = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
            answers.append(near_best.withColumn("rank", F.row_number().over(whole)).where(
                F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    if not answers:
        schema = StructType().add("item_id", item_type).add("rank", IntegerType()).add(
            "doc_id", docs.schema[doc_id].dataType).add("score", LongType())
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, answers)
