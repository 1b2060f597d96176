"""The registered queries against their SQL, and the pipeline against its stages' rules."""

import bisect
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from wageband.llm import quality, toxicity
from wageband.llm.oracle import ORACLE_SQL
from wageband.llm.queries import QUERIES, tokenizer_path
from wageband.llm.common import table
from tests.llm.test_groups import Sets, _shingles, _spans
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLE_SQL[name], SF)[0] == "ok"


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    lexicon = toxicity.learn_lexicon(toxicity.training_rows(docs, table(spark, SF, "labels"), "toxic"))
    scores = toxicity.with_toxicity(docs, lexicon)
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns
    assert clean.count() == scores.where("score < 0.5").count()
    single = stages["ngram_join"](spark, clean, SF).cache()
    groups = QUERIES["op4_ngram_join"](spark, SF)
    assert single.count() <= clean.count() and groups.where("kept").count() <= docs.count()
    cut = stages["suffix_dedup"](spark, single, SF).cache()
    assert cut.where("n_chars <> length(text)").count() == 0
    mixed = stages["mixing"](spark, cut, SF)
    assert mixed.exceptAll(cut).count() == 0 and mixed.count() == cut.count()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() == cut.count()
    assert rows.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lexicon = toxicity.learn_lexicon(toxicity.training_rows(docs, table(spark, SF, "labels"), "toxic")).build()
    folder = toxicity.Folder()
    texts = {i: t for i, t in texts.items() if lexicon.score(lexicon.evidence(folder.fold(t))[0]) < 0.5}
    sets, groups = {i: _shingles(t) for i, t in texts.items()}, Sets()
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                groups.join(i, j)
    texts = {i: t for i, t in texts.items() if groups.find(i) == i}
    late = {}
    for i, a, b, again in _spans(sorted(texts.items())):
        if again:
            late.setdefault(i, set()).update(range(a, b))
    for i, gone in late.items():
        words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", texts[i])
        texts[i] = re.match(r"[\x20\x09-\x0D]*", texts[i]).group() + "".join(
            w for k, w in enumerate(words) if k not in gone)
    texts = {i: t for i, t in texts.items() if i not in late or t.split()}
    coder = Tokenizer.from_file(tokenizer_path())
    coder.no_truncation()
    expected = {i: coder.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == expected and len(found) == len(expected)


def _places(rows, block_rows=64, cycle=1000):
    """Slot and place in the mix of (doc_id, source) rows with distinct ids, and each source's share."""
    ranked = {}
    for i, source in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        ranked.setdefault(source, []).append(i)
    names = sorted(ranked)
    weight = {s: len(ranked[s]) ** 0.5 for s in names}
    exact = {s: weight[s] / sum(weight.values()) * (cycle - len(names)) for s in names}
    units = {s: int(exact[s]) + 1 for s in names}
    spare = sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in spare[:cycle - sum(units.values())]:
        units[s] += 1
    done, slots = dict.fromkeys(names, 0), {s: [] for s in names}
    for t in range(cycle):
        ready = [(-(-(done[s] + 1) * cycle // units[s]), s) for s in names
                 if done[s] < units[s] and done[s] * cycle // units[s] <= t]
        if ready:
            pick = min(ready)[1]
            done[pick] += 1
            slots[pick].append(t)
    places = {}
    for s in names:
        for rank, i in enumerate(ranked[s]):
            k = rank // block_rows
            slot = k // units[s] * cycle + slots[s][k % units[s]]
            places[i] = (slot, slot * block_rows + rank % block_rows)
    return places, {s: units[s] / cycle for s in names}


def test_pipeline_returns_the_mix(spark):
    found = corpus_pipeline.run(spark, SF).select("doc_id", "source", "slot", "mix_order").collect()
    places, _ = _places([(r["doc_id"], r["source"]) for r in found])
    assert len(places) == len(found) > 0
    assert {r["doc_id"]: (r["slot"], r["mix_order"]) for r in found} == places


def test_encoded_places_keep_the_shares(spark):
    # Rows in many files, in another order than the mix.
    docs = spark.range(0, 20_000, 1, 16).selectExpr(
        "id AS doc_id", "'a b' AS text", "'en' AS lang",
        "CASE WHEN id % 7 = 0 THEN 'y' WHEN id % 7 < 3 THEN 'x' ELSE 'z' END AS source", "3L AS n_chars")
    rows = corpus_pipeline.encode(spark, docs, SF).select("doc_id", "source", "slot", "mix_order").collect()
    places, shares = _places([(r["doc_id"], r["source"]) for r in rows])
    assert {r["doc_id"]: (r["slot"], r["mix_order"]) for r in rows} == places and len(places) == 20_000
    taken = {s: sorted({r["slot"] for r in rows if r["source"] == s}) for s in shares}
    for source, share in shares.items():
        for t in range(taken[source][-1] + 1):
            assert abs(bisect.bisect_left(taken[source], t) - t * share) < 1


def test_pipeline_decodes_the_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    texts = ["Hello, World's 3 ends!", "été Σας 中 <|endoftext|> abc", "", "  ", None, "again again", "again again"]
    docs = spark.createDataFrame([(i, t, "en", "x", 3) for i, t in enumerate(texts)],
                                 "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    rows = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def _naive_fold(folder, text):
    """Folding letter by letter."""
    chars = [folder.letters.get(ord(c), c) or "" for c in text] if not text.isascii() else list(text)
    text = "".join(chars).lower()

    def letter(i):
        return 0 <= i < len(text) and bool(re.fullmatch(r"[^\W\d_]", text[i]))

    out = list(text)
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "0123456789":
            j += 1
        if j > i and (letter(i - 1) or letter(j)):
            out[i:j] = [toxicity.DIGITS.get(c, c) for c in text[i:j]]
        i = max(j, i + 1)
    text, i = "".join(out), 0
    out = list(text)
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "@$!|+":
            j += 1
        if j > i and letter(i - 1) and letter(j):
            out[i:j] = [toxicity.SIGNS[c] for c in text[i:j]]
        i = max(j, i + 1)
    return " " + " ".join(re.findall(r"[^\W_]+", "".join(out))) + " "


def test_toxicity_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect() if r["toxic"] is not None}
    folder = toxicity.Folder()
    folded = {i: _naive_fold(folder, t) for i, t in docs.items()}
    learn = [i for i in docs if i in labels and zlib.crc32(str(i).encode()) % 5]
    counts = {0: Counter(), 1: Counter()}
    for i in learn:
        forms = set()
        for word in folded[i].split():
            forms |= {f" {word} "} | {f" {word[:n]}" for n in range(3, min(len(word), 12) + 1)}
        counts[labels[i]].update(forms)
    toxic, clean = (sum(labels[i] == y for i in learn) for y in (1, 0))
    found = {}
    for form, t in counts[1].items():
        w = math.log((t + 0.5) / (toxic + 1)) - math.log((counts[0][form] + 0.5) / (clean + 1))
        if t >= toxicity.LEAST_TEXTS and w >= toxicity.LEAST_WEIGHT:
            found[form] = (t, w)
    weights = toxicity._longest_equal(found)
    learned = toxicity.learn_lexicon(toxicity.training_rows(
        table(spark, SF, "documents"), table(spark, SF, "labels"), "toxic"))
    assert set(learned.weights) == set(weights) and len(found) < toxicity.MOST_ENTRIES
    assert all(abs(learned.weights[f] - w) < 1e-9 for f, w in weights.items())
    rows = QUERIES["op2_toxicity"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = folded[r["doc_id"]]
        spans = [(k, k + len(e) + 2) for e in learned.exceptions for k in range(len(text)) if text.startswith(f" {e} ", k)]
        best = {}
        for f, w in weights.items():
            for m in re.finditer(f"(?={re.escape(f)})", text):
                if len(f) > best.get(m.start(), (0, 0))[0]:
                    best[m.start()] = (len(f), w)
        kept = [w for k, (n, w) in best.items() if not any(a <= k and k + n <= b for a, b in spans)]
        evidence = sum(kept) / math.sqrt(max(toxicity.FEW_WORDS, len(text.split())))
        a, b = learned.curve
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(evidence)))))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert abs(r["score"] - score) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    model = quality.learn_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))

    def shape(text):
        return regex.sub(r"\p{N}+", "0", regex.sub(r"\p{Ll}+", "a", regex.sub(r"\p{Lu}+", "A", text)))

    def words_of(text):
        return re.findall(r"[^\x20\x09-\x0D]+", text)

    words = {i: words_of(t) for i, t in docs.items()}
    shapes = {i: words_of(shape(t)) for i, t in docs.items()}
    every = sorted({w for ws in [*words.values(), *shapes.values()] for w in ws})
    hashed = dict(spark.createDataFrame([(w,) for w in every], "w STRING").select("w", F.xxhash64("w")).collect())
    index, s_index = quality._dense(quality.SLOTS, 1), quality._dense(quality.SHAPES, 2)
    sums = np.zeros((quality.SLOTS, quality.WIDTH))
    slots = {i: [hashed[w] % quality.SLOTS for w in ws] for i, ws in words.items()}
    kinds = {i: [hashed[w] % quality.SHAPES for w in ws] for i, ws in shapes.items()}
    for i, ws in slots.items():
        for k, w in enumerate(ws):
            sums[w] += s_index[kinds[i][k]]
            for step in range(1, quality.REACH + 1):
                if k + step < len(ws):
                    sums[w] += index[ws[k + step]]
                    sums[ws[k + step]] += index[w]
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(model.vectors, vectors, atol=1e-6)
    rows = QUERIES["op5_quality_classifier"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws, ks = slots[r["doc_id"]], kinds[r["doc_id"]]
        x = np.zeros(2 * quality.WIDTH + 4)
        if ws:
            pairs = list(zip(ws, ws[1:]))
            x[:quality.WIDTH] = np.mean([vectors[w] for w in ws], 0)
            x[quality.WIDTH:-4] = np.mean([s_index[k] for k in ks], 0)
            x[-4:] = (math.log1p(len(ws)) / 10, sum(a == b for a, b in pairs) / len(ws),
                      (len(ws) - len(set(ws))) / len(ws), (len(pairs) - len(set(pairs))) / len(ws))
        hidden = np.maximum((x - model.network.mean) / model.network.spread @ model.network.w1 + model.network.b1, 0)
        logit = float(hidden @ model.network.w2 + model.network.b2) / model.network.temperature
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))) < 1e-3
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)
