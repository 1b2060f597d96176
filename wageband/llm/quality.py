"""Text quality: random-indexing word vectors, pooled per document, and a two-layer network.

Words are hashed into a fixed number of slots, so the vocabulary has a bound. Every slot and every
word shape has a sparse random index vector, made from its number alone. The vector of a slot is
the sum of the index vectors of the words around its occurrences and of their shapes, over all
documents; it is gathered by adding up the tasks' integer tables. A document is the mean of its
words' vectors, the mean of its shapes' index vectors, and a few plain ratios. The network is
fitted on a bounded number of labelled rows, and its scores are calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.llm.common import unused, words_of
from wageband.llm.toxicity import training_rows

SLOTS = 8192
SHAPES = 512
WIDTH = 64
SPARSE = 4
REACH = 2
TRAIN_ROWS = 8_000
HIDDEN = 32
EPOCHS = 150
CHUNKS = 16
PIECE = 1_000_000
BRANCHES = 32


def _index_vectors(count: int, seed: int):
    """``SPARSE`` places and signs per number, made by an integer hash."""
    import numpy as np

    n = np.arange(count * SPARSE, dtype=np.uint64) + np.uint64(seed << 32)
    n = (n ^ (n >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    n = (n ^ (n >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    n = n ^ (n >> np.uint64(31))
    place = (n % np.uint64(WIDTH)).astype(np.int64).reshape(count, SPARSE)
    sign = (1 - 2 * ((n >> np.uint64(40)) & np.uint64(1)).astype(np.int64)).reshape(count, SPARSE)
    return place, sign


def _dense(count: int, seed: int):
    import numpy as np

    place, sign = _index_vectors(count, seed)
    out = np.zeros((count, WIDTH), np.float32)
    np.add.at(out, (np.repeat(np.arange(count), SPARSE), place.ravel()), sign.ravel())
    return out


def _coded(df: DataFrame, text: str, slots: str = "_slots", shapes: str = "_shapes") -> DataFrame:
    """Slots and shapes of the words of every text, as arrays of numbers.

    A shape turns runs of capitals, small letters and digits into one letter each and keeps signs.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, "\\p{Lu}+", "A"), "\\p{Ll}+", "a"), "\\p{N}+", "0")
    return df.withColumns({
        slots: F.transform(words_of(value), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")),
        shapes: F.transform(words_of(shape), lambda w: F.pmod(F.xxhash64(w), F.lit(SHAPES)).cast("int")),
    })


def _flat(column):
    """Values and offsets, from 0, of a list column."""
    import numpy as np

    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy().astype(np.int64), offsets - offsets[0]


def slot_vectors(docs: DataFrame, text: str = "text"):
    """Unit-length vectors of all slots, from every document.

    Every task adds up one integer table of ``SLOTS`` x ``WIDTH``. The tables are cut into chunks,
    which are summed in two steps, streaming, so that no task holds more than a few tables. The
    sum, whose size is fixed, comes to the driver.
    """
    import numpy as np

    def count(batches):
        place, sign = _index_vectors(SLOTS, 1)
        s_place, s_sign = _index_vectors(SHAPES, 2)
        table = np.zeros(SLOTS * WIDTH, np.int64)

        def add(rows, places, signs):
            for k in range(SPARSE):
                table[:] += np.bincount(rows * WIDTH + places[:, k], signs[:, k], SLOTS * WIDTH).astype(np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                words, offsets = _flat(part.column(0))
                shapes, _ = _flat(part.column(1))
                owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                for a in range(0, len(words), PIECE):
                    b = min(a + PIECE, len(words))
                    add(words[a:b], s_place[shapes[a:b]], s_sign[shapes[a:b]])
                    for step in range(1, REACH + 1):
                        # Pairs whose first word is in this piece; the second may be beyond it.
                        one, two = words[a:b], words[a + step:b + step]
                        together = owner[a:b][:len(two)] == owner[a + step:b + step]
                        one, two = one[:len(two)][together], two[together]
                        add(one, place[two], sign[two])
                        add(two, place[one], sign[one])
        yield _chunks(table.astype(np.int64))

    def _chunks(table):
        import pyarrow as pa
        from pyspark import TaskContext

        branch = TaskContext.get().partitionId() % BRANCHES
        return pa.RecordBatch.from_arrays([
            pa.array(range(CHUNKS), pa.int32()), pa.array([branch] * CHUNKS, pa.int32()),
            pa.array([c.tobytes() for c in np.split(table, CHUNKS)], pa.binary())],
            names=["chunk", "branch", "sums"])

    def total(batches: Iterator):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                part = np.frombuffer(raw.as_buffer(), np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()),
                pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                names=["chunk", "branch", "sums"])

    schema = "chunk INT, branch INT, sums BINARY"
    coded = _coded(docs.select(F.col(text).alias("t")), "t").select("_slots", "_shapes")
    parts = coded.mapInArrow(count, schema)
    once = parts.repartition(BRANCHES, "branch").mapInArrow(total, schema)
    table = np.zeros((CHUNKS, SLOTS * WIDTH // CHUNKS), np.float64)
    for row in once.repartition(CHUNKS, "chunk").mapInArrow(total, schema).collect():
        table[row["chunk"]] += np.frombuffer(row["sums"], np.int64)
    table = table.reshape(SLOTS, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def document_features(words, offsets, shapes, vectors, shape_vectors):
    """One row per document: pooled word vector, pooled shape vector, plain ratios."""
    import numpy as np

    count = np.diff(offsets)
    rows = len(count)
    out = np.zeros((rows, 2 * WIDTH + 4), np.float32)
    some = np.flatnonzero(count > 0)
    if not len(some):
        return out
    for first in range(0, len(some), 256):
        ids = some[first:first + 256]
        a, b = offsets[ids[0]], offsets[ids[-1] + 1]
        starts = offsets[ids] - a
        out[ids, :WIDTH] = np.add.reduceat(vectors[words[a:b]], starts, axis=0) / count[ids, None]
        out[ids, WIDTH:2 * WIDTH] = np.add.reduceat(
            shape_vectors[shapes[a:b]], starts, axis=0) / count[ids, None]
    owner = np.repeat(np.arange(rows), count)
    same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    out[:, -4] = np.log1p(count) / 10.0
    out[:, -3] = np.bincount(owner[1:][same], minlength=rows) / np.maximum(count, 1)
    # Words met before in the document, and pairs of words met before.
    pair = owner * SLOTS + words
    out[:, -2] = _met_before(pair, owner, rows) / np.maximum(count, 1)
    two = (pair[:-1] * SLOTS + words[1:])[owner[1:] == owner[:-1]]
    out[:, -1] = _met_before(two, owner[:-1][owner[1:] == owner[:-1]], rows) / np.maximum(count, 1)
    return out


def _met_before(codes, owner, rows: int):
    import numpy as np

    fresh, first = np.unique(codes, return_index=True)
    return np.bincount(owner, minlength=rows) - np.bincount(owner[first], minlength=rows)


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a temperature."""
    mean: object
    spread: object
    w1: object
    b1: object
    w2: object
    b2: float
    temperature: float = 1.0

    def logits(self, x):
        import numpy as np

        hidden = np.maximum((x - self.mean) / self.spread @ self.w1 + self.b1, 0.0)
        return hidden @ self.w2 + self.b2

    def scores(self, x):
        import numpy as np

        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x, y, seed: int = 11) -> Network:
    """Adam on most of the rows, early stopping and the temperature on the rest.

    With no rows, or rows of one class only, the score is that class' smoothed share for any text.
    """
    import numpy as np

    width = x.shape[1]
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    start = float(np.log(share / (1 - share)))
    flat = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN),
                   np.zeros(HIDDEN), start)
    if len(y) < 20 or len(set(y.tolist())) < 2:
        return flat
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[:max(10, len(y) // 5)], order[max(10, len(y) // 5):]
    spread = x[used].std(0)
    net = Network(x[used].mean(0), np.where(spread > 1e-6, spread, 1.0),
                  rng.normal(0, np.sqrt(2.0 / width), (width, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, np.sqrt(1.0 / HIDDEN), HIDDEN), start)
    inputs = (x - net.mean) / net.spread
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, best_loss, step = [p.copy() for p in params], np.inf, 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            a, target = inputs[batch], y[batch]
            z = a @ params[0] + params[1]
            h = np.maximum(z, 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30)))
            d = (p - target) / len(batch)
            dh = np.outer(d, params[2]) * (z > 0)
            grads = [a.T @ dh + 1e-3 * params[0], dh.sum(0), h.T @ d + 1e-3 * params[2],
                     np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= 0.003 * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        z = np.maximum(inputs[held] @ params[0] + params[1], 0.0) @ params[2] + params[3][0]
        loss = _loss(z, y[held])
        if loss < best_loss:
            best, best_loss = [p.copy() for p in params], loss
    net.w1, net.b1, net.w2, net.b2 = best[0], best[1], best[2], float(best[3][0])
    z = net.logits(x[held])
    heats = np.exp(np.linspace(np.log(0.25), np.log(8.0), 101))
    net.temperature = float(heats[int(np.argmin([_loss(z / t, y[held]) for t in heats]))])
    return net


def _loss(z, y) -> float:
    import numpy as np

    return float((np.logaddexp(0, z) - y * z).mean())


@dataclass
class QualityModel:
    vectors: object
    network: Network


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
                  text: str = "text", rows: int = TRAIN_ROWS, parts: int = 5) -> QualityModel:
    """Word vectors of all documents and a network fitted on at most ``rows`` labelled ones.

    Labels are read only where crc32 of the key modulo ``parts`` is not 0. The fitted rows'
    features, ``rows`` x 132 numbers at most, come to the driver.
    """
    import numpy as np

    vectors = slot_vectors(docs, text)
    train = training_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")),
                          labels.select(F.col(key).alias("doc_id"), F.col(label).alias("y")), "y",
                          rows=rows, parts=parts)
    found = with_features(train, vectors).select("features", "label").collect()
    x = np.array([r["features"] for r in found], np.float64).reshape(len(found), 2 * WIDTH + 4)
    y = np.array([r["label"] for r in found], np.float64)
    order = np.lexsort(np.concatenate([x, y[:, None]], 1).T)  # rows come in no fixed order
    return QualityModel(vectors, fit_network(x[order], y[order]))


def _mapped(df: DataFrame, text: str, name: str, kind: str, vectors, work) -> DataFrame:
    kept = [c for c in df.columns if c.lower() != name]
    from pyspark.sql.types import StructType

    row = unused(df, "_text")
    slots, shapes = unused(df, "_slots"), unused(df, "_shapes")
    coded = _coded(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(row)), row, slots, shapes)
    fresh = StructType.fromDDL(f"{name} {kind}")
    schema = StructType([f for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema.fields] + fresh.fields)
    shared = df.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        import pyarrow as pa

        shape_vectors = _dense(SHAPES, 2)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words, offsets = _flat(part.column(part.num_columns - 2))
                shapes, _ = _flat(part.column(part.num_columns - 1))
                made = work(document_features(words, offsets, shapes, shared.value, shape_vectors))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(kept))] + [made], names=schema.names)

    return coded.select(*[F.col(f"`{c}`") for c in kept], slots, shapes).mapInArrow(run, schema)


def with_features(df: DataFrame, vectors, text: str = "text") -> DataFrame:
    """``df`` with the pooled ``features`` of each text."""
    def work(x):
        import pyarrow as pa

        return pa.array(x.astype("float64").tolist(), pa.list_(pa.float64()))

    return _mapped(df, text, "features", "ARRAY<DOUBLE>", vectors, work)


def with_quality(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``df`` with ``score``, the calibrated probability of good quality, by the text alone.

    A null, empty or blank text has all features zero and gets the network's score for that. Rows
    are judged one by one, so repeated rows get equal scores; texts are read whole and no row is
    dropped. A column named ``score`` is replaced. The vectors, 2 MB whatever the input, are broadcast.
    """
    packed = cloudpickle.dumps(model.network)

    def work(x):
        import pickle

        import pyarrow as pa

        return pa.array(pickle.loads(packed).scores(x.astype("float64")), pa.float64())

    return _mapped(df, text, "score", "DOUBLE", model.vectors, work)
