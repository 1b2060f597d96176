"""Near-duplicate vectors by navigable small-world graphs, one per shard.

Equal vectors form classes first. The rest is cut by label into shards of bounded size, and each
shard gets a hierarchical graph: a vector stands on level 0 and, with falling chance, on levels
above; on each level it is tied to near vectors that are not nearer to each other than to it.
Every vector then searches every shard of its label with a beam, so vectors of two shards search for
each other both ways. Searches are audited against brute force on some of the queries, by their true
nearest vectors, which every query has, and by their links; the beam is widened until both audits
pass, or the shard is compared as a whole. A vector as near as a true nearest one counts as it. Found links
are verified by cosine in double precision; inside a group that the found links tie together, all
pairs of the two shards are verified, so a dense group keeps all its links. Links are summed per
vector, and the components of the link graph are built without gathering any of them.
"""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.llm.common import stored
from wageband.llm.components import components

COSINE = 0.93
SHARD_ROWS = 16_384
# Tasks that shards, or pairs of them, are dealt over at most.
MOST_TASKS = 20_000
# Pairs of rows compared at once inside a task.
BLOCK_CELLS = 4_000_000
NEIGHBOURS = 16
BUILD_BEAM = 48
SEARCH_BEAM = 64
ENTRIES = 16  # places from which the level below is searched: some lie outside any one dense group
WIDER = 16  # one in so many beam entries is expanded at once, 3 at least
BATCH = 256
AUDITED = 96
AUDIT_RECALL = 1.0  # of the audited queries' links
AUDIT_NEAREST = 4
AS_NEAR = 1e-6  # similarities that differ by less are equal
NEAREST_RECALL = 0.99  # of the audited queries' true nearest vectors


class SmallWorld:
    """A hierarchical navigable small-world graph over the rows of a unit-length matrix."""

    def __init__(self, unit, seed: int = 7):
        import numpy as np

        self.unit = np.ascontiguousarray(unit, np.float32)
        count = len(unit)
        chance = np.random.default_rng(seed).random(count)
        scale = 1.0 / np.log(NEIGHBOURS)
        self.level = np.minimum((-np.log(np.maximum(chance, 1e-12)) * scale).astype(int), 12)
        self.ties = [np.full((count, NEIGHBOURS * (2 if lv == 0 else 1)), -1, np.int32)
                     for lv in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        done = 0
        while done < count:
            # Batches grow with the graph: the first vectors are put in one by one.
            size = max(1, min(BATCH, done // 4, count - done))
            self._insert(np.arange(done, done + size))
            done += size

    def state(self) -> bytes:
        """The graph without its vectors, as plain arrays."""
        return pickle.dumps((self.level, self.ties, self.entry))

    @classmethod
    def of_state(cls, state: bytes, unit) -> SmallWorld:
        import numpy as np

        graph = cls.__new__(cls)
        graph.unit = np.ascontiguousarray(unit, np.float32)
        graph.level, graph.ties, graph.entry = pickle.loads(state)
        return graph

    def _insert(self, fresh) -> None:
        import numpy as np

        if self.entry < 0:
            self.entry = int(fresh[0])
            return
        top = int(self.level[self.entry])
        at = np.full((len(fresh), 1), self.entry)
        inside = self.unit[fresh] @ self.unit[fresh].T
        np.fill_diagonal(inside, -2.0)
        for lv in range(top, -1, -1):
            joins = self.level[fresh] >= lv
            ids, sims = self._search(self.unit[fresh], at, lv, BUILD_BEAM if joins.any() else ENTRIES)
            at = ids[:, :ENTRIES]
            if joins.any():
                # Members of the batch do not see each other in the graph, but in this matrix.
                mates = np.where(joins[None, :], inside, -2.0)
                ids = np.concatenate([ids, np.broadcast_to(fresh, mates.shape)], 1)
                sims = np.concatenate([sims, mates], 1)
                order = np.argsort(-sims, 1, kind="stable")[:, :BUILD_BEAM]
                ids = np.take_along_axis(ids, order, 1)
                sims = np.take_along_axis(sims, order, 1)
                self._tie(fresh[joins], ids[joins], sims[joins], lv)
        highest = int(fresh[np.argmax(self.level[fresh])])
        if self.level[highest] > top:
            self.entry = highest

    def _chosen(self, ids, sims, most: int):
        """Per row the near ids, nearest first, that are not nearer to an id chosen before."""
        import numpy as np

        vectors = self.unit[np.maximum(ids, 0)]
        among = np.einsum("qad,qbd->qab", vectors, vectors)
        chosen = np.zeros(ids.shape, bool)
        usable = (ids >= 0) & (sims > -1.5)
        number = np.zeros(len(ids), int)
        for k in range(ids.shape[1]):
            hidden = (chosen & (among[:, k, :] > sims[:, k, None])).any(1)
            take = usable[:, k] & ~hidden & (number < most)
            chosen[:, k] = take
            number += take
        # Places left are filled with the nearest of the rest.
        rest = usable & ~chosen
        fill = rest & (np.cumsum(rest, 1) <= (most - number)[:, None])
        return chosen | fill

    def _tie(self, fresh, ids, sims, lv: int) -> None:
        import numpy as np

        ties = self.ties[lv]
        chosen = self._chosen(ids, sims, NEIGHBOURS)
        rows, cols = np.nonzero(chosen)
        place = np.cumsum(chosen, 1)[rows, cols] - 1
        ties[fresh[rows], place] = ids[rows, cols]
        # The ties back: as many of a vector's new and old ones as fit.
        source, target = fresh[rows], ids[rows, cols]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        width = int(counts.max())
        new = np.full((len(nodes), width), -1, np.int32)
        group = np.repeat(np.arange(len(nodes)), counts)
        new[group, np.arange(len(target)) - np.repeat(first, counts)] = source
        both = np.concatenate([ties[nodes], new], 1)
        # A tie that exists both ways already counts once.
        ordered = np.sort(both, 1)
        repeated = np.zeros(both.shape, bool)
        repeated[:, 1:] = (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)
        both = np.where(repeated, -1, ordered)
        near = np.einsum("nd,nkd->nk", self.unit[nodes], self.unit[np.maximum(both, 0)])
        near = np.where((both >= 0) & (both != nodes[:, None]), near, -2.0)
        order = np.argsort(-near, 1, kind="stable")[:, :BUILD_BEAM + ties.shape[1]]
        both, near = np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1)
        keep = self._chosen(np.where(near > -1.5, both, -1), near, ties.shape[1])
        fitted = np.full((len(nodes), ties.shape[1]), -1, np.int32)
        r, c = np.nonzero(keep)
        fitted[r, np.cumsum(keep, 1)[r, c] - 1] = both[r, c]
        ties[nodes] = fitted

    def _search(self, queries, start, lv: int, beam: int):
        """Nearest ids and similarities per query on a level, best first, by a beam from ``start``."""
        import numpy as np

        count, ties = len(queries), self.ties[lv]
        beam = max(beam, start.shape[1])
        wider = max(3, beam // WIDER)
        ids = np.full((count, beam), -1, np.int64)
        sims = np.full((count, beam), -2.0, np.float32)
        ids[:, :start.shape[1]] = start
        sims[:, :start.shape[1]] = np.where(
            start >= 0, np.einsum("qd,qsd->qs", queries, self.unit[np.maximum(start, 0)]), -2.0)
        seen = np.zeros((count, len(self.unit)), bool)
        r, c = np.nonzero(start >= 0)
        seen[r, start[r, c]] = True
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        waiting = ids >= 0
        active = np.arange(count)
        while len(active):
            open_ = waiting[active]
            first = open_ & (np.cumsum(open_, 1) <= wider)
            waiting[active] &= ~first
            r, c = np.nonzero(first)
            place = np.cumsum(first, 1)[r, c] - 1
            current = np.full((len(active), wider), -1, np.int64)
            current[r, place] = ids[active[r], c]
            around = np.where(current[:, :, None] >= 0, ties[np.maximum(current, 0)], -1)
            around = np.sort(around.reshape(len(active), -1), 1)
            around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
            safe = np.maximum(around, 0)
            fresh = (around >= 0) & ~seen[active[:, None], safe]
            r, c = np.nonzero(fresh)
            seen[active[r], around[r, c]] = True
            near = np.full(around.shape, -2.0, np.float32)
            near[r, c] = np.einsum("pd,pd->p", queries[active[r]], self.unit[around[r, c]])
            all_ids = np.concatenate([ids[active], around], 1)
            all_sims = np.concatenate([sims[active], near], 1)
            all_wait = np.concatenate([waiting[active], fresh], 1)
            order = np.argsort(-all_sims, 1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            sims[active] = np.take_along_axis(all_sims, order, 1)
            waiting[active] = np.take_along_axis(all_wait, order, 1) & (sims[active] > -1.5)
            active = active[waiting[active].any(1)]
        return ids, sims

    def nearest(self, queries, beam: int):
        """Ids and similarities of about the ``beam`` nearest rows, best first; -1 where none."""
        import numpy as np

        found, near = [], []
        for a in range(0, len(queries), BATCH):
            part = np.ascontiguousarray(queries[a:a + BATCH], np.float32)
            at = np.full((len(part), 1), self.entry)
            for lv in range(int(self.level[self.entry]), 0, -1):
                at = self._search(part, at, lv, ENTRIES)[0][:, :ENTRIES]
            ids, sims = self._search(part, at, 0, beam)
            found.append(ids)
            near.append(sims)
        return np.concatenate(found), np.concatenate(near)


def _unit(vectors):
    """Rows of length one. Each is divided by its largest component first, so no square over- or underflows."""
    import numpy as np

    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _joined(count: int, u, v, label=None):
    """The least member of its component for each of ``count`` nodes under the edges u - v.

    ``label`` is such a result for earlier edges, which stay.
    """
    import numpy as np

    label = np.arange(count) if label is None else label.copy()
    while (label[u] != label[v]).any():
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _candidates(graph: SmallWorld, unit_b, beam: int, cosine: float):
    """Rows of the graph and searching rows that a beam search finds to be links, with a hair of room,
    as searches are in single precision."""
    import numpy as np

    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, len(unit_b), BATCH):
        ids, sims = graph.nearest(unit_b[first:first + BATCH], beam)
        col, k = np.nonzero((ids >= 0) & (sims >= cosine - 1e-4))
        rows.append(ids[col, k])
        cols.append(col + first)
    return np.concatenate(rows), np.concatenate(cols)


def _all_ties(unit_a, unit_b, same: bool, cosine: float):
    """Links that tie the same rows together as all links do, by comparing all rows in blocks."""
    import numpy as np

    shift = 0 if same else len(unit_a)
    label, rows, cols = np.arange(shift + len(unit_b)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, BLOCK_CELLS // max(1, len(unit_b)))
    for first in range(0, len(unit_a), step):
        near = unit_a[first:first + step] @ unit_b.T >= cosine
        near &= label[first:first + len(near)][:, None] != label[shift:][None, :]
        r, c = np.nonzero(near)
        rows.append(r + first)
        cols.append(c)
        label = _joined(len(label), r + first, c + shift, label)
    return np.concatenate(rows), np.concatenate(cols)


def _searched(graph: SmallWorld, unit_a, unit_b, same: bool, cosine: float):
    """Links that the rows of ``unit_b`` find in a graph over ``unit_a``, and the beam.

    The audit takes evenly spaced queries and compares them with all rows. The beam doubles until it
    finds rows as near as nearly all of their true nearest ones that are no links, and until the links
    found tie each query to every row it truly links with, as all pairs of a group are verified later.
    In a group of near copies a beam finds only some of a row's links; that is enough to tie the group
    together. A beam as wide as the shard is a comparison with all of it.
    """
    import numpy as np

    audited = np.unique(np.linspace(0, len(unit_b) - 1, min(AUDITED, len(unit_b))).astype(int))
    near = unit_a @ unit_b[audited].T
    if same:
        near[audited, np.arange(len(audited))] = -2.0
    best = -np.sort(-near, 0)[:AUDIT_NEAREST]
    linked, query = np.nonzero(near >= cosine)
    shift = 0 if same else len(unit_a)
    beam = SEARCH_BEAM
    while beam < len(unit_a):
        ids, sims = graph.nearest(unit_b[audited], beam)
        if same:
            sims = np.where(ids == audited[:, None], -2.0, sims)
        top = -np.sort(-sims, 1)[:, :len(best)].T
        if ((top >= best - AS_NEAR) | (best >= cosine)).mean() >= NEAREST_RECALL:
            rows, cols = _candidates(graph, unit_b, beam, cosine)
            label = _joined(shift + len(unit_b), rows, cols + shift)
            if (label[linked] == label[audited[query] + shift]).sum() >= AUDIT_RECALL * len(linked):
                return rows, cols, beam
        beam *= 2
    return *_all_ties(unit_a, unit_b, same, cosine), len(unit_a)


class PairLinks:
    """The links between the rows of a shard, or of two shards, as groups whose pairs are verified.

    ``same``: both sides are one shard, and a row does not link with itself. ``other`` is the graph of
    the other rows, where the rows of the first search in turn.
    """

    def __init__(self, graph: SmallWorld, unit_a, unit_b, same: bool, cosine: float = COSINE,
                 other: SmallWorld | None = None):
        import numpy as np

        self.unit_a, self.unit_b, self.same, self.cosine = unit_a, unit_b, same, cosine
        self.shift = 0 if same else len(unit_a)
        rows, cols, self.beam = _searched(graph, unit_a, unit_b, same, cosine)
        if other is not None:
            back, from_, wide = _searched(other, unit_b, unit_a, False, cosine)
            rows, cols = np.concatenate([rows, from_]), np.concatenate([cols, back])
            self.beam = max(self.beam, wide)
        self.rows, self.cols = rows, cols
        self.group = _joined(self.shift + len(unit_b), rows, cols + self.shift)

    def blocks(self):
        """(rows, other rows, links among them) that cover every pair of every group, in double precision."""
        import numpy as np

        left, right = self.group[:len(self.unit_a)], self.group[self.shift:]
        by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        names, first_a, size_a = np.unique(left[by_left], return_index=True, return_counts=True)
        names_b, first_b, size_b = np.unique(right[by_right], return_index=True, return_counts=True)
        _, in_a, in_b = np.intersect1d(names, names_b, assume_unique=True, return_indices=True)
        if self.same:
            in_a = in_b = in_a[size_a[in_a] > 1]
        for i, j in zip(in_a, in_b):
            a, b = by_left[first_a[i]:first_a[i] + size_a[i]], by_right[first_b[j]:first_b[j] + size_b[j]]
            step = max(1, BLOCK_CELLS // len(b))
            for first in range(0, len(a), step):
                part = a[first:first + step]
                links = self.unit_a[part] @ self.unit_b[b].T >= self.cosine
                if self.same:
                    links[np.arange(len(part)), first + np.arange(len(part))] = False
                yield part, b, links

    def summed(self, copies_a, copies_b):
        """Per row of each side: links, links with copies; and the component of every row of both."""
        import numpy as np

        links = [np.zeros(len(copies_a), np.int64), np.zeros(len(copies_b), np.int64)]
        docs = [np.zeros(len(copies_a), np.int64), np.zeros(len(copies_b), np.int64)]
        rows, cols = self.rows, self.cols
        sound = np.einsum("pd,pd->p", self.unit_a[rows], self.unit_b[cols]) >= self.cosine
        label = _joined(len(self.group), rows[sound], cols[sound] + self.shift)
        for a, b, found in self.blocks():
            links[0][a] += found.sum(1)
            docs[0][a] += (found @ copies_b[b].astype(float)).astype(np.int64)
            links[1][b] += found.sum(0)
            docs[1][b] += (copies_a[a].astype(float) @ found).astype(np.int64)
            apart = found & (label[a][:, None] != label[b + self.shift][None, :])
            if apart.any():
                r, c = np.nonzero(apart)
                label = _joined(len(label), a[r], b[c] + self.shift, label)
        return links, docs, label


def linked_pairs(graph: SmallWorld, unit_a, unit_b, same: bool, cosine: float = COSINE,
                 other: SmallWorld | None = None):
    """Boolean matrix of the links of ``PairLinks``, with the widest beam used; for small shards."""
    import numpy as np

    pair = PairLinks(graph, unit_a, unit_b, same, cosine, other)
    links = np.zeros((len(unit_a), len(unit_b)), bool)
    for a, b, found in pair.blocks():
        links[np.ix_(a, b)] = found
    return links, pair.beam


def _build(rows: DataFrame, shards: int) -> DataFrame:
    """One row per (label, width, shard): classes, ids, copies, vectors and the graph, as bytes."""
    def build(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[tuple, list] = {}

        def close(key):
            parts = held.pop(key)
            classes, ids, copies, vectors = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.argsort(classes, kind="stable")
            classes, ids, copies, vectors = classes[order], ids[order], copies[order], vectors[order]
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()),
                pa.array([key[2]], pa.int32()), pa.array([key[3]], pa.int32()),
                pa.array([pickle.dumps((classes, ids, copies, vectors))], pa.binary()),
                pa.array([SmallWorld(_unit(vectors)).state()], pa.binary()),
            ], names=["lab", "dim", "shard", "shards", "block", "graph"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            classes, ids, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5, 6))
            offsets = batch.column(7).offsets.to_numpy()
            flat = batch.column(7).values.to_numpy(zero_copy_only=False)
            first = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[first]:
                    part = flat[offsets[first]:offsets[i]].reshape(i - first, -1)
                    for other in [k for k in held if k != keys[first]]:
                        yield close(other)
                    held.setdefault(keys[first], []).append(
                        (classes[first:i], ids[first:i], copies[first:i], part))
                    first = i
        for key in list(held):
            yield close(key)

    ordered = rows.repartition(shards, "lab", "dim", "shard").sortWithinPartitions("lab", "dim", "shard")
    return ordered.mapInArrow(
        build, "lab STRING, dim INT, shard INT, shards INT, block BINARY, graph BINARY")


def _linked(pairs: DataFrame, cosine: float) -> DataFrame:
    """Per class and pair of shards: its id, links with copies, least id reached."""
    def link(batches):
        import numpy as np
        import pyarrow as pa

        names = ["cid", "id", "doc_links", "least"]
        for batch in batches:
            for r in range(batch.num_rows):
                block, other, graph, other_graph = (batch.column(i)[r].as_py() for i in range(4))
                classes_a, ids_a, copies_a, vec_a = pickle.loads(block)
                same = other is None
                classes_b, ids_b, copies_b, vec_b = (
                    (classes_a, ids_a, copies_a, vec_a) if same else pickle.loads(other))
                unit_a = _unit(vec_a)
                unit_b = unit_a if same else _unit(vec_b)
                pair = PairLinks(SmallWorld.of_state(graph, unit_a), unit_a, unit_b, same, cosine,
                                 None if same else SmallWorld.of_state(other_graph, unit_b))
                links, docs, label = pair.summed(copies_a, copies_b)
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                least = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(least, label, ids)
                least = least[label]
                sides = [(classes_a, ids_a, links[0], docs[0], least[:len(ids_a)])]
                if not same:
                    sides.append((classes_b, ids_b, links[1], docs[1], least[len(ids_a):]))
                for classes, own, n, n_docs, reached in sides:
                    keep = np.flatnonzero(n)
                    if len(keep):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(x[keep], pa.int64()) for x in (classes, own, n_docs, reached)], names=names)

    return pairs.mapInArrow(link, "cid BIGINT, id BIGINT, doc_links BIGINT, least BIGINT")


def embedding_groups(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                     label: str = "label", cosine: float = COSINE,
                     shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared only with those of an equal, non-null label and equal width. Links have a
    cosine of ``cosine`` or more in double precision. ``n_links``: other vectors linked directly,
    copies included; ``component_id``: least key reachable by links; ``kept``: it is the vector's
    own. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and so do rows with a null key, which are kept. Repeated rows are copies of each
    other. Rows that share a key but not the vector have links of their own, and one component, as
    it is named by keys. Every row is returned; recall is audited for every pair of shards, both
    ways, by the true nearest vectors of some queries, so also where they have no links.

    A shard holds about ``shard_rows`` vectors, so a hot label has more shards, not larger ones.
    Each shard is built, and each pair of shards searched, by a task of its own.
    """
    values = F.col("v")
    sound = F.size("v") > 0
    sound = sound & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("lab"),
                          F.col(vector).cast("array<double>").alias("v"))
    usable = rows.where("id IS NOT NULL AND lab IS NOT NULL AND v IS NOT NULL").where(sound).where(
        F.exists(values, lambda x: x != 0))
    classes = stored(usable.groupBy("lab", "v").agg(
        F.min("id").alias("first"), F.count("*").alias("copies")).withColumn(
        "cid", F.monotonically_increasing_id()), "vector-classes")
    sizes = classes.groupBy("lab", F.size("v").alias("dim")).agg(
        F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    n_shards, n_pairs = sizes.agg(
        F.coalesce(F.sum("shards"), F.lit(0)),
        F.coalesce(F.sum(F.expr("shards * (shards + 1L) div 2")), F.lit(0))).first()
    placed = classes.withColumn("dim", F.size("v")).join(sizes, ["lab", "dim"]).select(
        "lab", "dim", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int").alias("shard"),
        "shards", "cid", F.col("first").alias("id"), "copies", "v")
    shards = stored(_build(placed, min(max(n_shards, 1), MOST_TASKS)), "vector-shards")
    # Each shard meets itself and every later shard of its label once; its row is rebuilt per pair.
    none = F.lit(None).cast("binary")
    own = shards.select("block", none.alias("other"), "graph", none.alias("other_graph"))
    later = shards.where("shard + 1 < shards").select(
        "lab", "dim", "block", "graph",
        F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("shard"))
    others = shards.select("lab", "dim", "shard", F.col("block").alias("other"),
                           F.col("graph").alias("other_graph"))
    across = later.join(others, ["lab", "dim", "shard"]).select("block", "other", "graph", "other_graph")
    pairs = own.union(across).repartition(min(max(n_pairs, 1), MOST_TASKS))
    links = stored(_linked(pairs, cosine), "vector-links")
    totals = links.groupBy("cid").agg(F.sum("doc_links").alias("doc_links"))
    groups = components(links.select(F.col("id").alias("u"), F.col("least").alias("v")),
                        "vector-components")
    found = classes.join(totals, "cid", "left").join(
        groups.withColumnRenamed("id", "first"), "first", "left")
    joined = rows.join(found.select("lab", "v", "first", "copies", "doc_links", "component"),
                       ["lab", "v"], "left")
    own_class = F.col("id").isNotNull() & F.col("first").isNotNull()
    return joined.select(
        F.col("id").alias(key),
        F.when(own_class, F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
        .cast("bigint").alias("n_links"),
        F.when(own_class, F.coalesce("component", "first")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
