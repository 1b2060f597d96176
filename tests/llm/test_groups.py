"""Operators over whole tables: joins, repeats, language model, vectors, mixing, components."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wageband.llm import embeddings, lm_score, mixing, ngram_join, suffix_dedup
from wageband.llm.common import remainder
from wageband.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    """Union-find for the expected components."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _corpus(seed=2, size=120):
    """Texts with copies, near copies, shared passages, short and odd ones."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage, texts = fresh(64), []
    for i in range(size):
        kind = rng.randrange(6)
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts:
            words = (rng.choice(texts) or "x").split()
            if words:
                words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(" ".join(fresh(rng.randrange(40)) + passage + fresh(rng.randrange(40))))
        else:
            texts.append(" ".join(fresh(rng.choice([2, 4, 5, 30, 90]))))
    return list(enumerate([*texts, None, "", " \n", "one", "one", "a b c d e " * 100]))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING")


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    found = dict(components(spark.createDataFrame([*edges, (None, 3)], "u BIGINT, v BIGINT")).collect())
    assert found == {x: sets.find(x) for e in edges for x in e if sets.find(x) != x or any(
        sets.find(y) == x for y in sets.up if y != x)}
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def _shingles(text):
    words = WORD.findall(text or "")
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join_against_brute_force(spark, block):
    rows = _corpus()
    sets = {i: _shingles(t) for i, t in rows}
    words = {i: tuple(WORD.findall(t or "")) for i, t in rows}
    groups, links = Sets(), Counter()
    for i, a in sets.items():
        groups.find(i)
        for j, b in sets.items():
            if i != j and a and b and (words[i] == words[j] or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                groups.join(i, j)
    docs = _frame(spark, [*rows, (None, "one two three four five six")]).withColumn("path", F.lit(1))
    found = ngram_join.ngram_join(docs, block=block).collect()
    assert len(found) == len(rows) + 1
    for row in found:
        if row["doc_id"] is not None:
            assert (row["n_links"], row["class_id"]) == (links[row["doc_id"]], groups.find(row["doc_id"]))
            assert row["kept"] == (row["class_id"] == row["doc_id"])
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


def test_runs_reach_the_recall():
    alive = 1.0
    for _ in range(ngram_join.DEPTH):
        alive = 1 - math.exp(-alive)
    assert (1 - alive) ** ngram_join.runs_needed(0.999) <= 0.001


def _spans(rows, least=50):
    first, count, texts = {}, Counter(), {}
    for i, t in rows:
        texts[i] = WORD.findall(t or "")
        for k in range(len(texts[i]) - least + 1):
            run = tuple(texts[i][k:k + least])
            count[run] += 1
            first.setdefault(run, (i, k))
    out = set()
    for i, w in texts.items():
        for late in (False, True):
            merged = []
            for k in range(len(w) - least + 1):
                run = tuple(w[k:k + least])
                if count[run] > 1 and not (late and first[run] == (i, k)):
                    if merged and merged[-1][1] >= k:
                        merged[-1][1] = k + least
                    else:
                        merged.append([k, k + least])
            out |= {(i, a, b, late) for a, b in merged}
    return out


@pytest.mark.parametrize("run_rows", [20_000, 3])
def test_repeats_against_brute_force(spark, monkeypatch, run_rows):
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", run_rows)
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", 50 if run_rows == 3 else 25_000)
    rows = _corpus(seed=8)
    found = suffix_dedup.repeated_spans(_frame(spark, [*rows, (None, "x " * 200)])).collect()
    assert {tuple(r) for r in found} == _spans(rows) and len(found) == len(_spans(rows))


def test_cutting_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"head  {passage}\ntail"), (2, f"other {passage} end"), (3, passage), (4, None), (5, "short text")]
    frame = _frame(spark, rows).withColumn("k", F.lit("k")).withColumn("row", F.lit(0))
    found = {r["doc_id"]: r["text"] for r in suffix_dedup.without_late_spans(frame).collect()}
    assert found == {1: rows[0][1], 2: "other end", 4: None, 5: "short text"}
    assert suffix_dedup.without_late_spans(frame.limit(0)).count() == 0
    assert suffix_dedup.without_late_spans(frame).columns == frame.columns


@pytest.mark.parametrize("run_rows", [20_000, 3])
def test_a_row_given_twice_is_no_repeat(spark, monkeypatch, run_rows):
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", run_rows)
    passage, other = (" ".join(f"{c}{i}" for i in range(70)) for c in "pq")
    rows = [(1, passage), (1, passage), (1, passage), (2, f"a {other}"), (2, f"b {other}"), (3, "short")]
    assert suffix_dedup.repeated_spans(_frame(spark, rows)).count() == 0
    assert Counter(r["text"] for r in suffix_dedup.without_late_spans(_frame(spark, rows)).collect()) == Counter(
        t for _, t in rows)
    # Another document with the passage is a repeat of the one document.
    found = suffix_dedup.without_late_spans(_frame(spark, [*rows, (4, f"x {passage} y")])).collect()
    assert Counter(r["text"] for r in found) == Counter([*[t for _, t in rows], "x y"])


def test_language_model(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary[:20 + i % 130]) for _ in range(60)).title()) for i in range(80)]
    rows += [(100 + i, t) for i, t in enumerate([None, "", "\x00 \x01", "unseenword", rows[0][1], rows[0][1]])]
    docs = _frame(spark, rows).withColumn("uid", F.lit(7)).withColumn("row", F.lit("r"))
    part = remainder(F.col("doc_id"), 10)
    counts = Counter()
    tokens = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        tokens[i] = [*WORD.findall(low), "\n"]
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    for frequent in (200_000, 5):
        found = {r["doc_id"]: r for r in lm_score.with_lm_scores(docs, part != 0, frequent=frequent).collect()}
        assert len(found) == len(rows)
        for i, words in tokens.items():
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
            row = found[i]
            assert row["base_score"] == pytest.approx(base) and row["n_tokens"] == len(words)
            assert row["n_known"] == sum(counts[w] > 0 for w in words) and row["train_tokens"] == total
            assert math.isfinite(row["score"]) and row["score"] < 0 and (row["uid"], row["row"]) == (7, "r")
    assert found[104]["score"] == pytest.approx(found[105]["score"])


def test_word_probabilities_add_up():
    words = [a + b for a in ("", "a", "b", "ab") for b in ("a", "b", "c")]
    count = np.arange(1.0, len(words) + 1)
    encoded = sorted(w.encode() for w in words)
    tables = np.zeros((lm_score.ORDERS, 1 << lm_score.SLOT_BITS, 2), np.float32)
    for order, used, n0, n1 in lm_score.bit_counts(encoded, count):
        tables[order, used, 0], tables[order, used, 1] = n0, n1
    average, volume, followed = lm_score.learn_online(encoded, count, tables)
    assert np.isfinite(average).all() and followed.sum() > 0
    middle = np.tile(1 / (1 + np.exp(-(np.arange(lm_score.STEPS) - lm_score.STEPS // 2) / 2.0)), (8, 1))
    # All first bytes, each followed by nothing else: their probabilities are a distribution.
    every = [bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32)]
    logs = {}
    for depth, rows, edge, parent, letter, before, seen in lm_score._levels(sorted(every), np.zeros(len(every))):
        if depth == 0:
            logs = letter
    assert len(logs) == len(every)
    mass = (10.0 ** lm_score.word_logs(encoded, count, tables, lm_score.start_weights(), middle)).sum()
    assert 0.3 < mass <= 1.0 + 1e-9


def test_language_model_of_nothing(spark):
    docs = _frame(spark, [(0, "a b")])
    empty = lm_score.with_lm_scores(docs.limit(0), F.lit(True))
    assert empty.count() == 0
    row = lm_score.with_lm_scores(docs, F.lit(False)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == pytest.approx(0.0)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(size=16) * (0.12 if i % 3 else 2.0)
        rows.append((i, [float(x) for x in v], i % 2 if i % 11 else None))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0, None], 1),
             (304, [], 1), (305, rows[1][1], 1), (306, [1.0] * 3, 1), (None, rows[1][1], 1)]
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, lab in rows
            if i is not None and lab is not None and (i < 300 or i in (305, 306))}
    label = {i: lab for i, _, lab in rows}
    groups, links = Sets(), Counter()
    for i, a in good.items():
        for j, b in good.items():
            if i != j and label[i] == label[j] and len(a) == len(b) and a @ b >= 0.93:
                links[i] += 1
                groups.join(i, j)
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    for shard_rows in (4096, 20):
        found = embeddings.embedding_groups(frame, shard_rows=shard_rows).collect()
        assert len(found) == len(rows)
        for r in found:
            if r["vec_id"] is not None:
                assert (r["n_links"], r["component_id"]) == (links[r["vec_id"]], groups.find(r["vec_id"]))
    assert embeddings.embedding_groups(frame.limit(0)).count() == 0


def test_vectors_of_extreme_length_and_shared_keys(spark):
    rows = [(1, [1e-200, 0.0], 1), (2, [1e200, 0.0], 1), (3, [3.0, 0.0], 1), (4, [0.0, 5e-324], 1),
            (5, [0.0, 1.0], 1), (6, [0.0, 0.0], 1),
            # One key with two vectors: each has its own links, the key one component.
            (20, [1.0, 0.0, 0.0], 2), (20, [0.0, 1.0, 0.0], 2), (21, [1.0, 0.1, 0.0], 2), (22, [1.0, 0.0, 0.1], 2),
            (23, [0.0, 1.0, 0.1], 2)]
    frame = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    found = Counter(tuple(r)[:3] for r in embeddings.embedding_groups(frame).collect())
    assert found == Counter([(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6),
                             (20, 2, 20), (20, 1, 20), (21, 2, 20), (22, 2, 20), (23, 1, 20)])


def test_dense_groups_need_no_wide_beam():
    rng = np.random.default_rng(11)
    base = rng.normal(size=32)
    points = np.concatenate([base + 0.05 * rng.normal(size=(500, 32)), rng.normal(size=(500, 32))])
    unit = _unit_rows(points)
    pair = embeddings.PairLinks(embeddings.SmallWorld(unit), unit, unit, True)
    copies = np.arange(1, 1001)
    links, docs, label = pair.summed(copies, copies)
    truth = unit @ unit.T >= 0.93
    np.fill_diagonal(truth, False)
    assert (links[0] == truth.sum(1)).all() and (docs[0] == truth @ copies).all()
    assert pair.beam < 500 and (label[:500] == 0).all()


def test_graph_recall():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 24))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    ids, _ = embeddings.SmallWorld(unit).nearest(unit, 48)
    near = np.argsort(-(unit @ unit.T), 1)[:, 1:6]
    assert np.mean([len(set(n) & set(i)) / 5 for n, i in zip(near, ids)]) >= 0.9


def _unit_rows(points):
    return points / np.linalg.norm(points, axis=1, keepdims=True)


class Blind:
    """A graph whose searches see only the first rows, until a beam spans all of them."""

    def __init__(self, unit, seen):
        self.unit, self.seen = unit, seen

    def nearest(self, queries, beam):
        sims = queries @ self.unit[:max(self.seen, beam // 4)].T
        ids = np.argsort(-sims, 1)[:, :beam]
        return ids, np.take_along_axis(sims, ids, 1)


def test_audit_needs_no_links():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(600, 16)), rng.normal(size=(600, 16))
    # Links of queries that the audit does not take: it has no link to miss.
    audited = set(np.linspace(0, 599, embeddings.AUDITED).astype(int))
    for i, j in ((500, 1), (510, 2), (520, 3)):
        assert j not in audited
        b[j] = a[i] + 0.01 * rng.normal(size=16)
    a, b = _unit_rows(a), _unit_rows(b)
    truth = a @ b.T >= 0.93
    assert truth[:, sorted(audited)].sum() == 0 and truth.sum() == 3
    links, beam = embeddings.linked_pairs(Blind(a, 300), a, b, False)
    assert (links == truth).all() and beam > embeddings.SEARCH_BEAM


def test_shards_search_both_ways(monkeypatch):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(300, 16)), rng.normal(size=(300, 16))
    b[7] = a[290] + 0.01 * rng.normal(size=16)
    a, b = _unit_rows(a), _unit_rows(b)
    # One way misses the pair although its audit passes; the other way finds it.
    monkeypatch.setattr(embeddings, "NEAREST_RECALL", 0.0)
    assert not embeddings.linked_pairs(Blind(a, 200), a, b, False)[0][290, 7]
    links, _ = embeddings.linked_pairs(Blind(a, 200), a, b, False, other=Blind(b, 300))
    assert (links == (a @ b.T >= 0.93)).all() and links[290, 7]


def test_mixing_keeps_the_shares(spark):
    rows = [(i, "big" if i % 3 else ("rare" if i % 2 else None), "s") for i in range(6000)] + [(None, "big", "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, slot STRING")
    weights = {"big": 0.5, "rare": 0.3, None: 0.2}
    mixed = mixing.mix_sources(docs, weights=weights, block_rows=4, cycle=100).toPandas()
    assert len(mixed) == len(rows) and mixed["mix_order"].is_unique
    order = mixed.sort_values("mix_order")
    units = dict(mixing.source_units(docs, "source", weights, 100).select("_source", "_units").collect())
    assert sum(units.values()) == 100
    blocks = order.drop_duplicates("slot")
    last = {s: g["slot"].max() for s, g in blocks.groupby(blocks["source"].fillna("-"))}
    for name, key in (("big", "1big"), ("rare", "1rare"), ("-", "0")):
        at = np.sort(blocks[blocks["source"].fillna("-") == name]["slot"].to_numpy())
        for t in range(int(last[name]) + 1):
            assert abs(np.searchsorted(at, t, "left") - t * units[key] / 100) < 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_run_bit_classes():
    rng = np.random.default_rng(2)
    row = np.repeat(np.arange(40), 12)
    k = np.concatenate([np.sort(rng.choice(30, 12, replace=False)) for _ in range(40)])
    holds, n = rng.integers(0, 2, 480), rng.integers(1, 12, 480)
    whole = n + rng.integers(0, 12, 480)
    found = lm_score._bit_classes(row, k, holds, n, whole)
    streak = 0
    for i in range(480):
        follows = i and row[i] == row[i - 1] and k[i] == k[i - 1] + 1 and holds[i - 1]
        streak = min(lm_score.HELD - 1, streak + 1) if follows else 0
        seen = min(n[i], lm_score.MOST_SEEN) * (lm_score.MOST_SEEN + 1) + min(whole[i] - n[i], lm_score.MOST_SEEN)
        assert found[i] == seen * lm_score.HELD + streak


def test_runs_are_cut_by_content():
    rng = np.random.default_rng(4)
    words = rng.integers(1, 2 ** 62, 400).astype(np.uint64)
    cuts, contexts, runs = lm_score._runs(words)
    shifted = np.concatenate([rng.integers(1, 2 ** 62, 7).astype(np.uint64), words])
    again = lm_score._runs(shifted)
    assert len(cuts) > 5 and set(zip(contexts, runs)) <= set(zip(again[1], again[2]))
    assert all(len(x) == 0 for x in lm_score._runs(words[:2]))


def test_copied_text_is_likelier(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(800)]
    copied = " ".join(rng.choice(vocabulary) for _ in range(300))
    rows = [(i, copied if i % 5 == 0 else " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(60)]
    part = remainder(F.col("doc_id"), 10)
    found = {r["doc_id"]: r for r in lm_score.with_lm_scores(_frame(spark, rows), part != 0).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    copies, others = [i for i in held if i % 5 == 0], [i for i in held if i % 5]
    assert all(found[i]["score"] > found[i]["base_score"] for i in copies)
    assert not copies or not others or min(found[i]["score"] for i in copies) > max(found[i]["score"] for i in others)
