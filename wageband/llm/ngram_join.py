"""Jaccard self-join of word 5-gram sets by chosen paths.

Equal word sequences form classes first; the rest works on one text per class. From the root of a
run a text follows every path of tokens (5-gram hashes) that chance picks: at a node that the text
reached, a token is followed when its hash falls into an interval which the node's name places and
which is as wide as 1 / (similarity * set size) of all hashes. Two texts that share a share
``similarity`` of the larger set follow on average one common token or more at every node, so such
pairs stay together with a known chance after ``depth`` steps, and other pairs drift apart. Runs
are repeated, each with its own intervals, until a pair at the threshold meets with the target
recall. Texts at the end of one path are compared in blocks of bounded size, so hot paths are
shared by many tasks. A pair that meets on several paths belongs to the least of them alone, so
links are counted without listing pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.llm.common import SHINGLE_WORDS, SIMILARITY, small_side, stored, tidied, words_of
from wageband.llm.components import components

DEPTH = 3
RECALL = 0.9995
BINS = 128
BLOCK = 512
# Standard errors the sketch estimate may lie below the threshold.
SLACK = 4.0


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    The common paths of such a pair branch like a Poisson process of mean one.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1.0 - math.exp(-alive)
    return math.ceil(math.log(1.0 - recall) / math.log(1.0 - alive))


def _mix(x):
    """A 64-bit finalizer on unsigned arrays; sums and products wrap around."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(hashes, ends, width: int):
    """Sorted distinct 64-bit shingles of each text from its word hashes.

    ``hashes`` holds the word hashes of all texts, ``ends`` where each text ends. A text of fewer
    than ``width`` words has one shingle of all its words; one without words has none.
    """
    import numpy as np

    hashes = hashes.astype(np.uint64)
    grams = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + len(grams)])
    start, sets = 0, []
    for end in ends:
        if end - start >= width:
            sets.append(np.unique(grams[start:end - width + 1]))
        elif end > start:
            one = np.array([end - start], np.uint64)
            for h in hashes[start:end]:
                one = _mix(one * np.uint64(0x9E3779B97F4A7C15) + h)
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
        start = end
    return sets


def chosen_paths(tokens, runs: int, depth: int, similarity: float):
    """Names of the path ends that a sorted token set reaches, over all runs."""
    import numpy as np

    size = len(tokens)
    if not size:
        return np.zeros(0, np.int64)
    nodes = _mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    width = int(2.0 ** 64 / (similarity * size)) if similarity * size > 1 else 2 ** 64 - 1
    for _ in range(depth):
        low = _mix(nodes)
        high = low + np.uint64(width)  # wraps around past the largest hash
        first = np.searchsorted(tokens, low, "left")
        last = np.searchsorted(tokens, high, "left")
        count = np.where(high >= low, last - first, size - first + last)
        parent = np.repeat(np.arange(len(nodes)), count)
        inside = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
        picked = tokens[(first[parent] + inside) % size]
        nodes = _mix(nodes[parent] * np.uint64(0x9E3779B97F4A7C15) + picked)
        if not len(nodes):
            break
    return np.unique(nodes).view(np.int64)


def sketch(tokens):
    """One byte per bin: from the least hash of the tokens in the bin, 0 for an empty bin."""
    import numpy as np

    out = np.zeros(BINS, np.uint8)
    if len(tokens):
        bins = (tokens & np.uint64(BINS - 1)).astype(np.int64)
        # Tokens are sorted, so the last one written per bin must be the least: go backwards.
        value = (_mix(tokens) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        out[bins[::-1]] = value[::-1]
    return out


def _prepared(docs: DataFrame, key: str, text: str, depth: int, runs: int, similarity: float,
              width: int) -> DataFrame:
    """Per document: id, class key (null without words), shingle count, path ends, sketch."""
    words = words_of(F.col(text))
    rows = docs.select(F.col(key).cast("bigint").alias("id"), words.alias("w")).select(
        "id", F.when(F.size("w") > 0, F.unhex(F.md5(F.array_join("w", " ")))).alias("key"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(2)
                offsets = lists.offsets.to_numpy()
                flat = lists.values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
                sets = shingle_sets(flat, (offsets[1:] - offsets[0]).tolist(), width)
                ends = [chosen_paths(s, runs, depth, similarity) for s in sets]
                at_end = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(at_end), pa.array(np.concatenate(ends), pa.int64())),
                    pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                ], names=["id", "key", "n", "paths", "sketch"])

    return rows.mapInArrow(tidied(run), "id BIGINT, key BINARY, n INT, paths ARRAY<BIGINT>, sketch BINARY")


def _in_blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Rows of every path in blocks (path, i, j): blocks of at most about ``block`` rows meet pairwise."""
    parts = F.ceil(F.col("size") / block).cast("int")
    spread = rows.join(sizes.select("path", parts.alias("parts")), "path").withColumn(
        "side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({
        "i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("parts", "other")


def _by_group(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on the rows of every (path, i, j): sorted partitions are read group by group.

    ``work`` takes a dictionary of column lists; it returns a dictionary of lists for ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = rows.columns
    fresh = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        held: list = []

        def finish(out):
            if held:
                whole = pa.Table.from_batches(held)
                held.clear()
                if whole.num_rows > 1:
                    made = work({c: whole.column(c).to_pylist() for c in names})
                    for name, values in made.items():
                        out.setdefault(name, []).extend(values)

        def batch_of(out):
            return pa.RecordBatch.from_pydict(out, schema=fresh)

        last, out = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("path", "i", "j")]
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            first = tuple(k[0] for k in keys)
            change[0] = first != last
            last = tuple(k[-1] for k in keys)
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            if cuts[0]:
                held.append(batch.slice(0, cuts[0]))
            for a, b in zip(cuts, cuts[1:]):
                finish(out)
                held.append(batch.slice(a, b - a))
            if out and len(next(iter(out.values()))) >= 10_000:
                yield batch_of(out)
                out = {}
        finish(out)
        if out:
            yield batch_of(out)

    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(tidied(run), schema)


def _own(path: int, paths: list, sides: list, i: int, j: int):
    """Which pairs of a block are its own: met on no lesser path, and across its two sides."""
    import numpy as np

    seen: dict[int, int] = {}
    rows, cols = [], []
    for r, mine in enumerate(paths):
        for p in mine:
            if p < path:
                rows.append(r)
                cols.append(seen.setdefault(p, len(seen)))
    own = ~np.eye(len(paths), dtype=bool)
    if rows:
        counts = np.bincount(cols, minlength=len(seen))
        shared = np.flatnonzero(counts > 1)
        if len(shared):
            place = np.full(len(seen), -1)
            place[shared] = np.arange(len(shared))
            at = place[cols]
            marks = np.zeros((len(paths), len(shared)), np.float32)
            marks[np.array(rows)[at >= 0], at[at >= 0]] = 1
            own &= (marks @ marks.T) < 0.5
    if i != j:
        side = np.array(sides)
        own &= side[:, None] != side[None, :]
    return own


def _candidates(similarity: float) -> Callable:
    """Rows of a block that have a pair of its own whose sketches and sizes allow the similarity."""
    def work(rows):
        import numpy as np

        n = np.array(rows["n"])
        marks = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, BINS)
        near = np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :])
        np.fill_diagonal(near, False)
        if not near.any():
            return {}
        # Some rows against all at a time: small blocks in one step, large ones in bounded memory.
        equal, filled = np.empty(near.shape, np.int16), np.empty(near.shape, np.int16)
        step = max(1, 4_000_000 // marks.size)
        for a in range(0, len(n), step):
            mine = marks[a:a + step, None, :]
            either = (mine | marks) != 0
            filled[a:a + step] = either.sum(2)
            equal[a:a + step] = ((mine == marks) & either).sum(2)
        slack = SLACK * np.sqrt(similarity * (1 - similarity) / np.maximum(filled, 1))
        near &= equal >= (similarity - slack) * filled
        if near.any():
            near &= _own(rows["path"][0], rows["paths"], rows["side"], rows["i"][0], rows["j"][0])
        keep = np.flatnonzero(near.any(1)).tolist()
        return {c: [rows[c][k] for k in keep] for c in ("path", "i", "j", "side", "id")}

    return work


def _verified(similarity: float) -> Callable:
    """Exact links of a block's own pairs: per row their number, and an edge to its group's least id."""
    def work(rows):
        import numpy as np

        sets = [np.frombuffer(s, np.uint64) for s in rows["tokens"]]
        n = np.array([len(s) for s in sets])
        token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, code, count = np.unique(token, return_inverse=True, return_counts=True)
        shared = count > 1  # a token of one row alone is in no intersection
        place = np.cumsum(shared) - 1
        row, code = row[shared[code]], place[code[shared[code]]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for low in range(0, int(shared.sum()), 8192):
            a, b = np.searchsorted(code, [low, low + 8192])
            part = np.zeros((len(sets), min(8192, int(shared.sum()) - low)), np.float32)
            part[row[a:b], code[a:b] - low] = 1
            common += part @ part.T
        both = n[:, None] + n[None, :] - common
        # Compared with a hair of room, as 0.8 has no exact binary form.
        linked = (common >= similarity * both - 1e-6) & (rows_id(rows)[:, None] != rows_id(rows)[None, :])
        np.fill_diagonal(linked, False)
        if linked.any():
            linked &= _own(rows["path"][0], rows["paths"], rows["side"], rows["i"][0], rows["j"][0])
        ids, copies = rows_id(rows), np.array(rows["copies"])
        keep = np.flatnonzero(linked.any(1))
        least = _least_reached(linked, ids)
        return {"id": ids[keep].tolist(), "links": linked[keep].sum(1).tolist(),
                "doc_links": (linked[keep] @ copies).tolist(), "least": least[keep].tolist()}

    def rows_id(rows):
        import numpy as np

        return np.array(rows["id"], np.int64)

    return work


def _least_reached(linked, ids):
    """Least id that each row reaches inside a block."""
    import numpy as np

    least = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        around = np.where(linked, least[None, :], big).min(1)
        fresh = np.minimum(least, around)
        if (fresh == least).all():
            return least
        least = fresh


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text",
               similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH,
               width: int = SHINGLE_WORDS, block: int = BLOCK) -> DataFrame:
    """One row per document: ``key``, ``class_id``, ``copy_of``, ``n_copies``, ``n_text_links``, ``n_links``, ``kept``.

    Documents are linked when the Jaccard similarity of their sets of word ``width``-grams is
    ``similarity`` or more; shorter texts have one gram of all their words. ``copy_of``: least id
    with the same words, ``n_copies``: documents with them. ``n_text_links``: other word sequences
    linked directly; ``n_links``: other documents linked directly, copies included. ``class_id``:
    least id reached by links, itself included; ``kept``: the document is that one.

    Found pairs are verified on their whole sets, so none below the similarity is linked; a pair at
    the threshold is found with probability ``recall``, more similar ones more surely. Texts that
    are null or without words link with nothing. Rows that share an id count as one document.
    A null id links with nothing, has no class and is kept. Every row is returned.
    """
    runs = runs_needed(recall, depth)
    prepared = stored(_prepared(docs, key, text, depth, runs, similarity, width), "ngram-prepared")
    classes = stored(prepared.where("id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("copy_of"), F.count("*").alias("copies")), "ngram-classes")
    # One row per class; a first row stands for all rows of one id, whose texts are equal here.
    reps = prepared.join(classes, "key").where("id = copy_of").dropDuplicates(["key"])
    ends = reps.select("id", F.explode("paths").alias("path"))
    sizes = ends.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    live = stored(ends.join(sizes, "path"), "ngram-live")
    met = live.groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    texts = stored(met.join(reps.select("id", "n", "sketch", "copies"), "id"), "ngram-texts")
    path_sizes = live.select("path", "size").distinct()
    rows = _in_blocks(texts.select("id", "n", "paths", "sketch", F.explode("paths").alias("path")),
                      path_sizes, block)
    wanted = stored(_by_group(
        rows.select("path", "i", "j", "side", "id", "n", "paths", "sketch"), _candidates(similarity),
        "path BIGINT, i INT, j INT, side INT, id BIGINT"), "ngram-wanted")
    wanted_ids = small_side(stored(wanted.select("id").distinct(), "ngram-ids"))
    links = stored(_by_group(
        wanted.join(_token_sets(docs, key, text, wanted_ids, width), "id").join(
            texts.select("id", "paths", "copies"), "id").select(
            "path", "i", "j", "side", "id", "paths", "copies", "tokens"), _verified(similarity),
        "id BIGINT, links BIGINT, doc_links BIGINT, least BIGINT"), "ngram-links")
    totals = links.groupBy("id").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    groups = components(links.select(F.col("id").alias("u"), F.col("least").alias("v")), "ngram-components")
    found = classes.join(totals.withColumnRenamed("id", "copy_of"), "copy_of", "left").join(
        groups.withColumnRenamed("id", "copy_of"), "copy_of", "left")
    joined = prepared.select("id", "key").join(found, "key", "left")
    zero = F.lit(0).cast("bigint")
    own = F.col("id").isNotNull() & F.col("copy_of").isNotNull()
    return joined.select(
        F.col("id").alias(key),
        F.when(own, F.coalesce("component", "copy_of")).otherwise(F.col("id")).alias("class_id"),
        F.when(own, F.col("copy_of")).otherwise(F.col("id")).alias("copy_of"),
        F.when(own, F.col("copies")).otherwise(F.lit(1).cast("bigint")).alias("n_copies"),
        F.when(own, F.coalesce("links", zero)).otherwise(zero).alias("n_text_links"),
        F.when(own, F.coalesce("doc_links", zero) + F.col("copies") - 1).otherwise(zero).alias("n_links"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("class_id"), F.lit(True)))


def _token_sets(docs: DataFrame, key: str, text: str, ids: DataFrame, width: int) -> DataFrame:
    """Whole token sets, as bytes, of the texts with the given ids."""
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).join(
        ids, "id").dropDuplicates(["id"])
    rows = chosen.select("id", F.transform(words_of(F.col("t")), lambda x: F.xxhash64(x)).alias("h"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                offsets = part.column(1).offsets.to_numpy()
                flat = part.column(1).values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
                sets = shingle_sets(flat, (offsets[1:] - offsets[0]).tolist(), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "tokens"])

    return rows.mapInArrow(tidied(run), "id BIGINT, tokens BINARY")
