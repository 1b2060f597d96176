"""Ranked search, token counts and periodic runs against brute force, and their odd inputs."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import SF
from wageband.llm import periodic_runs, search, token_counts
from wageband.llm.common import table
from wageband.llm.queries import QUERIES, tokenizer_path

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = "piece_bpe_32k.model"


# --- ranked search ----------------------------------------------------------------------------

def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _ranked(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document; docs are (id, text) rows."""
    counted = [(i, Counter(_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def _found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    q = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    return [tuple(r) for r in search.ranked_search(d, q, **kw).collect()]


def _order(rows):
    return sorted(rows, key=repr)


def test_search_equals_scoring_every_document(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 300)  # several shards
    monkeypatch.setattr(search, "BLOCK_CHARS", 400)  # several blocks of items
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Ärger", "naïve", "X1-y2", "naïVE"]
    docs = [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 120]))))
            for i in range(150)]
    docs += [(200 + i, "copy of one text w1 w2 w3") for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)] + [(99, "COPY w2")]
    assert _order(_found(spark, docs, items)) == _order(_ranked(docs, items))
    assert _order(_found(spark, docs, items, k=3)) == _order(_ranked(docs, items, 3))


def test_search_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .-\n"), (4, "alpha beta"), (4, "alpha beta"), (None, "alpha"), (5, "gamma \x00delta"),
            (6, "beta " * 30_000), (7, "DÉJÀ déjà dÉjÀ")]
    items = [(1, "Alpha beta"), (1, "Alpha beta"), (1, "gamma"), (2, None), (3, "..."), (4, "unseen"),
             (None, "delta DÉJÀ beta")]
    expected = _ranked(docs, [i for i in items if i[1]])
    assert _order(_found(spark, docs, items)) == _order(expected)
    # A term that every document holds weighs nothing, so nothing scores above 0.
    assert _found(spark, [(i, "same words") for i in range(600)], [(1, "same")]) == []


def test_search_of_empty_tables_and_clashing_names(spark):
    assert _found(spark, [], [(1, "a")]) == []
    assert _found(spark, [(1, "a")], []) == []
    assert _found(spark, [(1, None)], [(1, "a")]) == []
    d = spark.createDataFrame([(1, "a b", "x", 2, 3), (2, "c", "y", 4, 5)],
                              "doc_id BIGINT, text STRING, terms STRING, row INT, doc INT")
    q = spark.createDataFrame([("i", "c d", 7)], "item_id STRING, text STRING, score INT")
    found = search.ranked_search(d, q)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r)[:3] for r in found.collect()] == [("i", 1, 2)]


# --- token counts -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))


def _random_texts(n):
    rng = random.Random(8)
    pools = ["abc de", "<s></s><unk> ", "äöü ñ漢字😀", "\n\t  \x00", "0123456789"]
    return ["".join(rng.choices(rng.choice(pools) + "the and of ", k=rng.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library(spark, tmp_path, model):
    texts = [None, "", " ", "  two  spaces ", "long word " * 40_000, "<s> in a text </s>"] + _random_texts(300)
    rows = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id BIGINT, text STRING")
    cache = token_counts.CountCache(str(tmp_path))
    found = token_counts.with_token_counts(rows, tokenizer_path(MODEL), cache).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        assert r["n_tokens"] == len(model.encode(r["text"] or ""))
        assert r["n_bytes"] == len((r["text"] or "").encode())


def test_counts_by_the_other_library(spark, tmp_path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = _random_texts(50)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    counted = token_counts.with_token_counts(rows, tokenizer_path("byte_bpe_50k.json"),
                                             token_counts.CountCache(str(tmp_path)))
    assert {r["doc_id"]: r["n_tokens"] for r in counted.collect()} == {
        i: len(coder.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_path(MODEL), token_counts.CountCache(str(tmp_path))
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(100)], "doc_id BIGINT, text STRING")
    assert token_counts.add_missing(rows, path, cache) == 7
    assert token_counts.add_missing(rows, path, cache) == 0
    more = rows.union(spark.createDataFrame([(200, "new"), (201, "new"), (202, None)], rows.schema))
    assert token_counts.add_missing(more, path, cache) == 2
    assert cache.read(spark, token_counts.tokenizer_version(path)).count() == 9
    # Counts of another tokenizer are not taken for this one's.
    assert token_counts.add_missing(rows, tokenizer_path("byte_bpe_50k.json"), cache) == 7
    # A stored count is used as it is: a planted one comes back.
    planted = spark.createDataFrame([("zzz",)], "text STRING").select(
        token_counts.content_digest(F.col("text")).alias("digest"), F.lit(123).cast("bigint").alias("n_tokens"))
    cache.append(planted, token_counts.tokenizer_version(path))
    one = spark.createDataFrame([(1, "zzz")], rows.schema)
    assert token_counts.with_token_counts(one, path, cache).first()["n_tokens"] == 123
    # The same when the missing digests are too many to broadcast.
    monkeypatch.setattr(token_counts, "MOST_BROADCAST_DIGESTS", 2)
    other = token_counts.CountCache(str(tmp_path / "other"))
    assert token_counts.add_missing(more, path, other) == 9
    keys = [cache.read(spark, token_counts.tokenizer_version(path)), other.read(spark, token_counts.tokenizer_version(path))]
    assert keys[1].exceptAll(keys[0]).count() == 0


def test_unfinished_append_is_not_read(spark, tmp_path):
    cache, version = token_counts.CountCache(str(tmp_path)), "v"
    counts = spark.createDataFrame([(bytearray(b"a"), 1)], token_counts.COUNTS)
    cache.append(counts, version)
    cache.append(counts, version)  # two writers with the same content
    folder = next((tmp_path / "tokenizer=v").iterdir())
    assert cache.read(spark, version).count() == 1
    cache.append(spark.createDataFrame([(bytearray(b"b"), 2)], token_counts.COUNTS), version)
    for other in (tmp_path / "tokenizer=v").iterdir():
        if other != folder:
            os.remove(other / "_SUCCESS")
    assert [r["n_tokens"] for r in cache.read(spark, version).collect()] == [1]


def test_counts_of_empty_table_and_clashing_names(spark, tmp_path, model):
    path, cache = tokenizer_path(MODEL), token_counts.CountCache(str(tmp_path))
    layout = "text STRING, digest STRING, _digest INT, N_Tokens STRING, _key INT, n INT"
    assert token_counts.with_token_counts(spark.createDataFrame([], layout), path, cache).count() == 0
    rows = spark.createDataFrame([("a b c", "x", 1, "y", 2, None), (None, None, None, None, None, 3)], layout)
    found = token_counts.with_token_counts(rows, path, cache)
    assert found.columns == ["text", "digest", "_digest", "_key", "n", "n_bytes", "n_tokens"]
    assert sorted(r["n_tokens"] for r in found.collect()) == [0, len(model.encode("a b c"))]


def test_counts_query(spark, model):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    found = QUERIES["op12_token_counts"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(model.encode(texts[r["doc_id"]]))
        assert tuple(r)[1:] == (len(texts[r["doc_id"]].encode()), n, n > 4096)


# --- periodic runs ----------------------------------------------------------------------------

def _runs(words, least):
    """Every maximal run, by comparing the words with themselves at every distance."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _words(rng, letters, n):
    words = [rng.choice("abcde"[:letters]) for _ in range(n)]
    if words and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(1 + (n - a) // 2)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)] + ["a", "b"] * rng.randrange(3)
    return words


@pytest.mark.parametrize("least", [2, 5, 12, 30])
def test_runs_equal_comparing_all_distances(least):
    rng = random.Random(least)
    docs = [_words(rng, rng.choice([1, 2, 3, 5]), rng.randrange(90)) for _ in range(700)]
    runs, left = periodic_runs.runs_of([" \n".join(d) for d in docs], least)
    for words, found, text in zip(docs, runs, left):
        expected = sorted(_runs(words, least), key=lambda r: (r[0], r[2]))
        assert [(r["start"], r["length"], r["period"]) for r in found] == expected
        gone = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert text == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_need_the_order_of_suffixes():
    rng = random.Random(1)
    words = _words(rng, 2, 400)
    text = [ord(w) for w in words] + [0]
    import numpy as np

    array = periodic_runs.SuffixArray.of(np.array(text))
    assert array.order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert array.place[array.order].tolist() == list(range(len(text)))
    for slot in range(1, len(text)):
        a, b, n = text[array.order[slot - 1]:], text[array.order[slot]:], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert array.common[slot] == n


def test_runs_of_odd_rows(spark):
    layout = "doc_id BIGINT, text STRING, runs STRING, _text INT, Collapsed INT"
    assert periodic_runs.with_runs(spark.createDataFrame([], layout)).count() == 0
    long = "x y z w " * 100_000  # a no-break space is no blank of the word rule
    texts = [None, "", " \n\x0b", "a " * 11, "a " * 12, "a " * 12, "a b " * 6 + "c", long]
    rows = spark.createDataFrame([(i, t, "r", 1, 2) for i, t in enumerate(texts)], layout)
    found = periodic_runs.with_runs(rows).orderBy("doc_id").collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "_text", "runs", "collapsed"}
    as_is = [([tuple(x) for x in r["runs"]], r["collapsed"]) for r in found]
    assert as_is[:4] == [([], ""), ([], ""), ([], ""), ([], " ".join("a" * 11))]
    assert as_is[4] == as_is[5] == ([(0, 12, 1)], "a")
    assert as_is[6] == ([(0, 12, 2)], "a b c")
    assert as_is[7] == ([(0, 300_000, 3)], "x y z w")
