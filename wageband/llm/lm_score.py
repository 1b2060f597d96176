"""Language-model scores by logistic context mixing over the bits of words.

A text is its lower-cased words, each closed by a blank, and an end mark. The bits of every byte
are predicted from what came before in the word: one count table per context order, addressed by a
hash of the last bytes and the bits so far, and the exact counts after the whole beginning of the
word. The predictions are mixed in the logistic domain with weights that a gate picks by bit and by
how much the contexts have seen; the weights are learned online, word beginning by word beginning,
each occurrence predicted from the others. The mix is refined adaptively by a table of what bits
really followed such predictions. As these predictions never look past the word, a word's
probability is worked out once and added up over all texts.

One more bit looks past the word: texts are cut into runs where a hash of the last three words says
so, and at every cut a bit tells whether the run that followed these words most often in training
follows again. If so the run costs that bit alone. The bit's probability comes from how often the
context and that run were seen and whether the bits before it held, learned from the training texts
with every text's own occurrence taken off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wageband.llm.common import stored

ORDERS = 4
SLOT_BITS = 20
FREQUENT = 200_000
COUNTED_AT_ONCE = 1_000_000
INPUTS = ORDERS + 2
# Bounds of how often a word beginning was seen, for the gate.
SEEN = (0.5, 1.5, 3.5, 15.5, 127.5)
GATES = 8 * 6 * 2
STEPS = 33
BATCH = 4096
RATE = 0.002
END = b"\n"
# Words that are hashed for a cut, one in how many places is one, and the classes of the run bit.
CUT_WORDS = 3
CUT_EVERY = 16
MOST_SEEN = 8
HELD = 4


def _hash(order: int, context, node):
    """Slot of a context's bit node in the table of its order."""
    import numpy as np

    x = (context.astype(np.uint64) << np.uint64(8)) | node.astype(np.uint64)
    x = (x + np.uint64(order << 50)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _sequences(words: list[bytes]):
    """Bytes of all words laid end to end, each closed by a blank, and where each begins and ends."""
    import numpy as np

    marked = [w if w == END else w + b" " for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(marked), np.uint8), ends - sizes, ends


def _context(history, order: int):
    import numpy as np

    return history & np.uint64((1 << (8 * order)) - 1)


def _stretch(n0, n1):
    import numpy as np

    return np.log((n1 + 0.4) / (n0 + 0.4))


# --- counting -------------------------------------------------------------------------------

def word_counts(docs: DataFrame, text: str, train: Column) -> DataFrame:
    """``word`` (bytes), ``c`` (occurrences in training texts) and ``n`` (in all), the end mark included.

    Tasks count into a table of bounded size and hand it on; equal words are added up by Spark.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), train.alias("train"))

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def emit(known, other):
            words = list(known.keys() | other.keys())
            return pa.RecordBatch.from_arrays([
                pa.array(words, pa.binary()), pa.array([known[w] for w in words], pa.int64()),
                pa.array([known[w] + other[w] for w in words], pa.int64())], names=["word", "c", "n"])

        known, other = Counter(), Counter()
        for batch in batches:
            for value, is_train in zip(batch.column(0), batch.column(1).to_pylist()):
                count = known if is_train else other
                # bytes.lower() and bytes.split() know ASCII letters and white space only.
                count.update(value.as_py().lower().split())
                count[END] += 1
                if len(known) + len(other) > COUNTED_AT_ONCE:
                    yield emit(known, other)
                    known, other = Counter(), Counter()
        yield emit(known, other)

    return rows.mapInArrow(run, "word BINARY, c BIGINT, n BIGINT").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"))


def bit_counts(words: list[bytes], count):
    """Bit counts of some words in every hashed context: per order the touched slots, n0 and n1."""
    import numpy as np

    size = 1 << SLOT_BITS
    data, starts, ends = _sequences(words)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    place = np.arange(len(data)) - starts[owner]
    history = np.zeros(len(data), np.uint64)
    for back in range(ORDERS, 0, -1):
        before = np.where(place >= back, data[np.maximum(np.arange(len(data)) - back, 0)], 0x20)
        history = (history << np.uint64(8)) | before.astype(np.uint64)
    for order in range(1, ORDERS + 1):
        code = (_context(history, order) << np.uint64(8)) | data.astype(np.uint64)
        code, where = np.unique(code, return_inverse=True)
        weight = np.bincount(where, count[owner])
        context, byte = code >> np.uint64(8), (code & np.uint64(255)).astype(np.int64)
        sums = np.zeros((2, size))
        for b in range(8):
            slot = _hash(order, context, (1 << b) | (byte >> (8 - b)))
            bit = (byte >> (7 - b)) & 1
            sums[0] += np.bincount(slot, weight * (1 - bit), size)
            sums[1] += np.bincount(slot, weight * bit, size)
        used = np.flatnonzero(sums.any(0))
        yield order - 1, used, sums[0][used], sums[1][used]


def context_tables(words: DataFrame):
    """Bit counts per order and slot from all training words: arrays of (orders, slots, 2).

    Tasks add up their words by context and byte, spread them over bit nodes and hand on the slots
    they touched. The tables' size is fixed by ``SLOT_BITS``.
    """
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            count = batch.column(1).to_numpy().astype(np.float64)
            for order, used, n0, n1 in bit_counts(batch.column(0).to_pylist(), count):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), order, np.int32)), pa.array(used.astype(np.int32)),
                    pa.array(n0), pa.array(n1)], names=["o", "slot", "n0", "n1"])

    counted = words.where("c > 0").select("word", "c").mapInArrow(
        run, "o INT, slot INT, n0 DOUBLE, n1 DOUBLE").groupBy("o", "slot").agg(
        F.sum("n0").cast("float").alias("n0"), F.sum("n1").cast("float").alias("n1"))
    tables = np.zeros((ORDERS, 1 << SLOT_BITS, 2), np.float32)
    found = counted.toArrow()
    at = found.column("o").to_numpy(), found.column("slot").to_numpy()
    tables[at[0], at[1], 0] = found.column("n0").to_numpy()
    tables[at[0], at[1], 1] = found.column("n1").to_numpy()
    return tables


# --- one partition of words as a tree -------------------------------------------------------

def _levels(words: list[bytes], count) -> Iterator[tuple]:
    """The tree of word beginnings, byte by byte.

    Yields per depth: the rows of words that reach it, the edge of each, and the edges' parents,
    bytes, histories and training counts, sorted by parent and byte.
    """
    import numpy as np

    data, starts, ends = _sequences(words)
    rows = np.arange(len(words))
    node = np.zeros(len(words), np.int64)
    history = np.full(1, 0x20202020, np.uint64)
    depth = 0
    while len(rows):
        byte = data[starts[rows] + depth]
        key, edge = np.unique(node[rows] * 256 + byte, return_inverse=True)
        parent, letter = key >> 8, key & 255
        before = history[parent]
        yield depth, rows, edge, parent, letter, before, np.bincount(edge, count[rows])
        history = ((before << np.uint64(8)) | letter.astype(np.uint64)) & np.uint64(0xFFFFFFFF)
        node[rows] = edge
        depth += 1
        rows = rows[starts[rows] + depth < ends[rows]]


def _bit_nodes(parent, letter, before, seen, b: int, depth: int, tables):
    """Bit nodes at bit ``b``: the node of each edge, and per node its counts in every context.

    Counts are (contexts, nodes, 2); the last context is the whole word beginning, which is exact
    from ``ORDERS`` bytes on, and is the longest hashed context before.
    """
    import numpy as np

    key = (parent * 256 + letter) >> (8 - b)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    of_edge = np.cumsum(fresh) - 1
    bit = (letter >> (7 - b)) & 1
    own = np.stack([np.add.reduceat(seen * (1 - bit), first), np.add.reduceat(seen * bit, first)], 1)
    partial = (1 << b) | (letter[first] >> (8 - b))
    counts = np.empty((ORDERS + 1, len(first), 2))
    for order in range(1, ORDERS + 1):
        counts[order - 1] = tables[order - 1][_hash(order, _context(before[first], order), partial)]
    counts[ORDERS] = own if depth >= ORDERS else counts[ORDERS - 1]
    return of_edge, bit, own, counts


def _inputs(counts, b: int):
    """Mixer inputs and gates of bit nodes."""
    import numpy as np

    x = np.empty((counts.shape[1], INPUTS))
    x[:, :-1] = _stretch(counts[:, :, 0], counts[:, :, 1]).T
    x[:, -1] = 0.3
    total = counts[ORDERS].sum(1)
    middle = counts[2].sum(1)
    gate = b * 12 + np.digitize(total, SEEN) * 2 + (middle >= 4)
    return x, gate


def _steps(z):
    """Refinement bucket of a mixed prediction."""
    import numpy as np

    return np.clip(np.rint(z * 2) + STEPS // 2, 0, STEPS - 1).astype(np.int64)


def start_weights():
    """Weights before learning: the word beginning rules once it was seen often."""
    import numpy as np

    weights = np.zeros((8, len(SEEN) + 1, 2, INPUTS))
    for seen, own in enumerate((0.0, 0.3, 0.5, 0.7, 0.85, 0.95)):
        weights[:, seen, :, 1:ORDERS] = (1 - own) * np.array([0.15, 0.3, 0.55])
        weights[:, seen, :, ORDERS] = own
    return weights.reshape(GATES, INPUTS)


def learn_online(words: list[bytes], count, tables):
    """One pass over a partition's tree: weights summed over its course, by their use, the use, and
    which bits followed the predictions."""
    import numpy as np

    weights, power = start_weights(), np.full((GATES, INPUTS), 1e-2)
    average = np.zeros((GATES, INPUTS))
    followed = np.zeros((8, STEPS, 2))
    volume = np.zeros(GATES)
    for depth, _, _, parent, letter, before, seen in _levels(words, count):
        for b in range(8):
            _, _, own, counts = _bit_nodes(parent, letter, before, seen, b, depth, tables)
            batch = min(BATCH, max(64, len(own) // 16))
            for low in range(0, len(own), batch):
                part, mine = counts[:, low:low + batch], own[low:low + batch]
                for bit in (0, 1):
                    heavy = np.flatnonzero(mine[:, bit] > 0)
                    if not len(heavy):
                        continue
                    # Every occurrence is predicted from the others: it is taken off its counts.
                    others = part[:, heavy].copy()
                    others[:, :, bit] = np.maximum(others[:, :, bit] - 1, 0)
                    x, gate = _inputs(others, b)
                    z = (x * weights[gate]).sum(1)
                    p = 1.0 / (1.0 + np.exp(-np.clip(z, -15, 15)))
                    # Common beginnings weigh more, but by the root of their count.
                    weight = np.sqrt(mine[heavy, bit])
                    np.add.at(followed[b, :, bit], _steps(z), mine[heavy, bit])
                    error = (bit - p) * weight
                    total = np.bincount(gate, weight, GATES)
                    slope = np.stack([np.bincount(gate, error * x[:, i], GATES) for i in range(INPUTS)], 1)
                    slope /= np.maximum(total, 1e-9)[:, None]
                    power += slope * slope
                    weights += RATE * slope / np.sqrt(power)
                    average += weights * total[:, None]
                    volume += total
    return average, volume, followed


def word_logs(words: list[bytes], count, tables, weights, refined):
    """log10 probability of each word under the mixed model."""
    import numpy as np

    out = np.zeros(len(words))
    for depth, rows, edge, parent, letter, before, seen in _levels(words, count):
        logs = np.zeros(len(parent))
        for b in range(8):
            of_edge, bit, _, counts = _bit_nodes(parent, letter, before, seen, b, depth, tables)
            x, gate = _inputs(counts, b)
            z = (x * weights[gate]).sum(1)
            p = 0.5 / (1.0 + np.exp(-np.clip(z, -15, 15))) + 0.5 * refined[b, _steps(z)]
            p = np.clip(p, 1e-6, 1 - 1e-6)[of_edge]
            logs += np.log10(np.where(bit == 1, p, 1 - p))
        out[rows] += logs[edge]
    return out


# --- the model on Spark ---------------------------------------------------------------------

def _by_beginning(words: DataFrame) -> DataFrame:
    """Words that share their first bytes stand together, sorted."""
    head = F.substring("word", 1, ORDERS)
    return words.select("word", "c", "n").repartition(head).sortWithinPartitions("word")


def _whole(batches):
    """All words of a partition, which holds distinct words only."""
    import numpy as np

    words, counts, totals = [], [], []
    for batch in batches:
        words += batch.column(0).to_pylist()
        counts.append(batch.column(1).to_numpy())
        totals.append(batch.column(2).to_numpy())
    if not words:
        return words, np.zeros(0), np.zeros(0)
    return words, np.concatenate(counts).astype(np.float64), np.concatenate(totals)


def score_words(words: DataFrame) -> DataFrame:
    """``word``, ``c``, ``n`` and ``lm``, the model's log10 probability of the word and its blank."""
    import numpy as np

    spark = words.sparkSession
    tables = spark.sparkContext.broadcast(context_tables(words))
    ordered = _by_beginning(words)

    def train(batches):
        import pyarrow as pa

        found, count, _ = _whole(batches)
        keep = np.flatnonzero(count > 0)
        if not len(keep):
            return
        average, volume, followed = learn_online([found[i] for i in keep], count[keep], tables.value)
        flat = np.concatenate([average.ravel(), volume, followed.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    summed = np.zeros(GATES * INPUTS + GATES + 8 * STEPS * 2)
    for row in ordered.mapInArrow(train, "i INT, v DOUBLE").groupBy("i").agg(F.sum("v").alias("v")).collect():
        summed[row["i"]] = row["v"]
    volume = summed[GATES * INPUTS:GATES * (INPUTS + 1)]
    weights = np.where(volume[:, None] > 0, summed[:GATES * INPUTS].reshape(GATES, INPUTS)
                       / np.maximum(volume, 1e-9)[:, None], start_weights())
    followed = summed[GATES * (INPUTS + 1):].reshape(8, STEPS, 2)
    middle = 1.0 / (1.0 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2.0))
    refined = (followed[:, :, 1] + 4 * middle) / (followed.sum(2) + 4)

    def score(batches):
        import pyarrow as pa

        found, count, totals = _whole(batches)
        if found:
            logs = word_logs(found, count, tables.value, weights, refined)
            for a in range(0, len(found), 50_000):
                b = a + 50_000
                yield pa.RecordBatch.from_arrays([
                    pa.array(found[a:b], pa.binary()), pa.array(count[a:b].astype(np.int64)),
                    pa.array(totals[a:b], pa.int64()), pa.array(logs[a:b])],
                    names=["word", "c", "n", "lm"])

    return ordered.mapInArrow(score, "word BINARY, c BIGINT, n BIGINT, lm DOUBLE")


def with_lm_scores(docs: DataFrame, train: Column, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """The columns of ``docs`` but its text, and ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, ``bits_per_byte``.

    ``train`` says which rows the model may learn from. Tokens are the words, with A-Z lowered, and
    one end per text; a null or blank text is its end alone. ``base_score`` is the sum over tokens of
    log10((c + 0.1) / (N + 0.1 * (V + 1))), with c the token's count, N all and V the distinct ones in
    training. ``score`` is the mixed model's log10 probability of the text. Without training rows the
    model falls back to its start weights. Rows are scored one by one, repeated rows alike, none is
    dropped and texts are read whole. Result columns replace input columns of the same name.

    The values of words that occur often, ``frequent`` at most, are broadcast; all others are joined.
    """
    import numpy as np
    import xxhash

    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kept = [c for c in docs.columns if c.lower() not in names]
    words = stored(word_counts(docs, text, train), "lm-counts")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"),
                      F.count(F.when(F.col("c") > 0, 1)).alias("V")).first()
    floor = math.log10(total["N"] + 0.1 * (total["V"] + 1))
    scored = stored(score_words(words).withColumn(
        "base", F.log10(F.col("c") + 0.1) - F.lit(floor)), "lm-words")
    # The least power of two above which there are no more words than may be broadcast.
    sizes = scored.groupBy(F.floor(F.log2(F.col("n"))).alias("p")).count().orderBy(F.desc("p")).collect()
    taken, least = 0, None
    for row in sizes:
        taken += row["count"]
        if taken > frequent:
            break
        least = 2 ** int(row["p"])
    common = scored.where(F.col("n") >= F.lit(least)) if least is not None else scored.where("false")
    found = common.select("word", "c", "base", "lm").toArrow()
    common_words = found.column("word").to_pylist()
    values = docs.sparkSession.sparkContext.broadcast((
        {w: i for i, w in enumerate(common_words)},
        # One row more, of zeros, so that an empty table can be looked up too.
        np.concatenate([np.stack([found.column("base").to_numpy(), found.column("lm").to_numpy(),
                                  (found.column("c").to_numpy() > 0).astype(float)], 1), np.zeros((1, 3))]),
        np.array([*map(xxhash.xxh64_intdigest, common_words), 0], np.uint64)))

    def look_up(batches):
        import pyarrow as pa
        import xxhash

        place, table, own_hash = values.value
        get, digest = place.get, xxhash.xxh64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sums = np.zeros((part.num_rows, 3))
                tokens, sizes = [], []
                lists: list[list] = [[], [], [], [], []]
                for i, value in enumerate(part.column(1)):
                    raw = value.as_py()
                    mine = raw.lower().split()
                    mine.append(END)
                    known = np.array([get(w, -1) for w in mine])
                    met = known >= 0
                    hashes = np.where(met, own_hash[known], np.uint64(0))
                    missing = np.flatnonzero(~met)
                    hashes[missing] = [digest(mine[k]) for k in missing.tolist()]
                    cuts, contexts, runs = _runs(hashes[:-1])
                    log = np.where(met, table[known, 1], 0.0)
                    run_of = np.searchsorted(cuts, np.arange(len(mine)), "right") - 1
                    run_of[-1] = -1  # the end mark stands outside the runs
                    sums[i] = (table[known[met], 0].sum(), log[run_of < 0].sum(), table[known[met], 2].sum())
                    tokens.append(len(mine))
                    sizes.append(len(raw) + 1)
                    inside = run_of >= 0
                    for made, new in zip(lists, (
                            hashes[missing].view(np.int64), run_of[missing], contexts.view(np.int64),
                            runs.view(np.int64),
                            np.bincount(run_of[inside], log[inside], len(cuts)) if len(cuts) else np.zeros(0))):
                        made.append(new)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(tokens, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(sums[:, 2]),
                    *[pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)),
                        pa.array(np.concatenate(made), kind)) for made, kind in zip(lists, kinds)],
                    part.column(2), part.column(3)],
                    names=["uid", "n_tokens", "size", "base", "head", "known", "rest", "rest_run", "contexts",
                           "runs", "run_logs", "row", "train"])

    def with_hash(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            hashes = [xxhash.xxh64_intdigest(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(hashes, np.uint64).view(np.int64)), *batch.columns[1:]],
                names=["h", "base", "lm", "known"])

    # Rows have no key of their own: they are numbered in the pass that is written.
    others_kept = [c for c in kept if c != text]
    numbered = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"),
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others_kept]).alias("row"),
        train.alias("train"))
    row_type = numbered.schema["row"].dataType.simpleString()
    first = stored(numbered.mapInArrow(
        look_up, "uid BIGINT, n_tokens BIGINT, size BIGINT, base DOUBLE, head DOUBLE, known DOUBLE, "
                 "rest ARRAY<BIGINT>, rest_run ARRAY<INT>, contexts ARRAY<BIGINT>, runs ARRAY<BIGINT>, "
                 f"run_logs ARRAY<DOUBLE>, row {row_type}, train BOOLEAN"), "lm-frequent")
    bits = stored(_run_bits(first), "lm-bits")
    chance = _learn_run_bits(bits)
    followed = first.select("uid", "head", "run_logs", "rest", "rest_run").join(
        bits.select("uid", "bits"), "uid", "left").mapInArrow(
        _run_scores(chance), "uid BIGINT, lm DOUBLE, rest ARRAY<STRUCT<h:BIGINT,told:DOUBLE>>")
    followed = stored(followed, "lm-followed")
    rare = scored.where(F.col("n") < F.lit(least)) if least is not None else scored
    hashed = rare.select("word", "base", "lm", (F.col("c") > 0).cast("double").alias("known")).mapInArrow(
        with_hash, "h BIGINT, base DOUBLE, lm DOUBLE, known DOUBLE")
    others = followed.select("uid", F.inline("rest")).join(hashed, "h").groupBy("uid").agg(
        F.sum("base").alias("base_rest"), F.sum("known").alias("known_rest"),
        F.sum(F.col("lm") * F.col("told")).alias("lm_rest"))
    zero = F.lit(0.0)
    score = F.col("lm") + F.coalesce("lm_rest", zero)
    return first.select("uid", "n_tokens", "size", "base", "known", "row").join(
        followed.select("uid", "lm"), "uid").join(others, "uid", "left").select(
        *[F.col(f"row.`{c}`") for c in others_kept],
        "n_tokens", (F.col("known") + F.coalesce("known_rest", zero)).cast("bigint").alias("n_known"),
        F.lit(int(total["N"])).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", zero)).alias("base_score"), score.alias("score"),
        (-score / F.lit(math.log10(2)) / F.col("size")).alias("bits_per_byte"))


# --- the bit that looks past the word -------------------------------------------------------

def _spread(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(hashes):
    """Where runs begin, the hash of the words before each, and the hash of each run."""
    import numpy as np

    none = np.zeros(0, np.uint64)
    if len(hashes) <= CUT_WORDS:
        return np.zeros(0, np.int64), none, none
    context = np.zeros(len(hashes) - CUT_WORDS, np.uint64)
    for k in range(CUT_WORDS):
        context = _spread(context * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + len(context)])
    at = np.flatnonzero(context % np.uint64(CUT_EVERY) == 0)
    if not len(at):
        return np.zeros(0, np.int64), none, none
    cuts = at + CUT_WORDS
    ends = np.append(cuts[1:], len(hashes))
    step = np.arange(cuts[0], len(hashes)) - np.repeat(cuts, ends - cuts)
    mixed = _spread(hashes[cuts[0]:] + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    runs = np.add.reduceat(mixed, cuts - cuts[0]) + (ends - cuts).astype(np.uint64)
    return cuts, context[at], _spread(runs)


def _run_bits(first: DataFrame) -> DataFrame:
    """Per row the runs whose context was seen in training: place, whether the bit holds, counts.

    Equal runs after equal words are counted before any shuffle by context, so common contexts
    are spread; a row gathers the bits of its own runs only.
    """
    met = first.select("uid", "train", F.posexplode(F.arrays_zip("contexts", "runs")).alias("k", "x")).select(
        "uid", "train", "k", F.col("x.contexts").alias("context"), F.col("x.runs").alias("run"))
    best = met.where("train").groupBy("context", "run").agg(F.count("*").alias("n")).groupBy("context").agg(
        F.max_by("run", F.struct("n", "run")).alias("best"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return met.join(best, "context").groupBy("uid", "train").agg(F.sort_array(F.collect_list(F.struct(
        "k", (F.col("run") == F.col("best")).cast("int").alias("holds"), "n", "all"))).alias("bits"))


def _bit_classes(row, k, holds, n, whole):
    """Class of each bit: times the run and others were seen, and how many bits just held."""
    import numpy as np

    held = np.zeros(len(k) + HELD, bool)  # whether the bit before, of the same row, held
    held[HELD + 1:] = (row[1:] == row[:-1]) & (k[1:] == k[:-1] + 1) & (holds[:-1] == 1)
    streak, still = np.zeros(len(k), np.int64), np.ones(len(k), bool)
    for back in range(HELD - 1):
        still &= held[HELD - back:HELD - back + len(k)]
        streak += still
    return (np.minimum(n, MOST_SEEN) * (MOST_SEEN + 1) + np.minimum(whole - n, MOST_SEEN)) * HELD + streak


def _flat_list(column):
    """Values of a list column laid end to end, and the row of each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _bits_of(column):
    import numpy as np

    values, row = _flat_list(column)
    return row, *(values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))


def _learn_run_bits(bits: DataFrame):
    """Chance that a bit of each class holds, from the training rows without their own occurrences."""
    import numpy as np

    classes = (MOST_SEEN + 1) ** 2 * HELD

    def count(batches):
        import pyarrow as pa

        table = np.zeros((classes, 2), np.int64)
        for batch in batches:
            row, k, holds, n, whole = _bits_of(batch.column(0))
            left = whole > 1
            row, k, holds, n, whole = row[left], k[left], holds[left], n[left] - holds[left], whole[left] - 1
            # A run seen only here is no longer the one expected.
            holds = np.where(n > 0, holds, 0)
            np.add.at(table, (_bit_classes(row, k, holds, n, whole), holds), 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(classes), pa.int32()), pa.array(table[:, 0]), pa.array(table[:, 1])],
            names=["i", "no", "yes"])

    table = np.zeros((classes, 2))
    for row in bits.where("train").select("bits").mapInArrow(
            count, "i INT, no BIGINT, yes BIGINT").groupBy("i").agg(F.sum("no"), F.sum("yes")).collect():
        table[row[0]] = row[1], row[2]
    seen = (np.arange(classes) // HELD // (MOST_SEEN + 1), np.arange(classes) // HELD % (MOST_SEEN + 1))
    prior = (seen[0] + 0.2) / (seen[0] + seen[1] + 1.0)
    return (table[:, 1] + 4 * prior) / (table.sum(1) + 4)


def _run_scores(chance):
    """Sums of the bits and of the words they leave to be told; words not looked up yet go on."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.num_rows
            run_logs, run_row = _flat_list(batch.column(2))
            rest, rest_row = _flat_list(batch.column(3))
            rest_run = _flat_list(batch.column(4))[0].to_numpy(zero_copy_only=False)
            row, k, holds, n, whole = _bits_of(batch.column(5))
            first = np.searchsorted(run_row, np.arange(rows))
            p = np.clip(chance[_bit_classes(row, k, holds, n, whole)], 1e-6, 1 - 1e-6)
            told = np.ones(len(run_logs) + 1)  # the last is for words outside the runs
            told[first[row] + k] = 1 - holds
            logs = batch.column(1).to_numpy() + np.bincount(
                row, np.log10(np.where(holds == 1, p, 1 - p)), rows) + np.bincount(
                run_row, run_logs.to_numpy(zero_copy_only=False) * told[:-1], rows)
            of_rest = told[np.where(rest_run < 0, len(told) - 1, first[rest_row] + rest_run)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(rest_row, minlength=rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(logs, pa.float64()), pa.ListArray.from_arrays(
                    pa.array(ends), pa.StructArray.from_arrays([rest, pa.array(of_rest)], names=["h", "told"]))],
                names=["uid", "lm", "rest"])

    return run
