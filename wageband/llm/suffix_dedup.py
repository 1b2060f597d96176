"""Repeated passages by a sparse suffix array.

Only suffixes at minimisers are kept: in every run of ``least - gram + 1`` consecutive word grams
the one with the least hash. Two copies of a passage of ``least`` words or more have a minimiser
at the same place of it, so some of their kept suffixes begin alike. Suffixes whose gram is unique
are dropped; the rest is dealt out by gram and sorted by content. Neighbours that begin alike are
extended to the right along the suffix and to the left before it: for each number of words to the
left the suffixes are put in the order of the longer text, and neighbours that agree on ``least``
words are repeats. A gram with very many suffixes is cut into several runs of bounded length; the
first of each text in every run are then compared over the runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wageband.llm.common import BLANK_PATTERN, small_side, stored, tidied, words_of

LEAST_WORDS = 50
GRAM = 20
# Suffixes of one gram that form one run; grams with more have several runs of about this length.
RUN_ROWS = 20_000
# Rows that are put in order at once: whole runs, as many as reach this number.
HELD_ROWS = 25_000


def _mix(x):
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _joined(a, b):
    import numpy as np

    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def gram_hashes(words, gram: int):
    """Hash of the ``gram`` words from each place on, by doubling; the last places run short."""
    import numpy as np

    count = len(words) - gram + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, size, done, out = words, 1, 0, None
    while True:
        if gram & size:
            part = power[done:done + count]
            out = part if out is None else _joined(out, part)
            done += size
        size *= 2
        if size > gram:
            return _mix(out)
        half = size // 2
        power = _joined(power[:-half], power[half:])


def _sliding(values, width: int, pick):
    """``pick`` (minimum or maximum) over every run of ``width`` values."""
    size, out = 1, values
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def minimisers(words, starts, ends, gram: int, window: int):
    """Places and gram hashes of the minimisers of many texts laid end to end."""
    import numpy as np

    grams = gram_hashes(words, gram)
    if len(grams) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding(grams, window, np.minimum)
    # Runs that reach into the next text say nothing.
    inside = np.zeros(len(least) + 1, np.int64)
    first, last = np.asarray(starts), np.asarray(ends) - gram - window + 2
    long = last > first
    np.add.at(inside, first[long], 1)
    np.add.at(inside, last[long], -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
    # A gram is a minimiser if it equals the least of some run around it: the greatest of those.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    reach = _sliding(padded, window, np.maximum)[:len(grams)]
    at = np.flatnonzero((reach == grams) & (reach > 0))
    return at, grams[at]


def _word_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("id"), F.transform(
        words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))


def _parts(batches, rows: int = 500):
    """Slices of batches with their word hashes laid end to end and the borders of the texts."""
    import numpy as np

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            lists = part.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy()[offsets[0]:offsets[-1]].view(np.uint64)
            borders = offsets - offsets[0]
            yield part, flat, borders[:-1], borders[1:]


def _suffixes(hashed: DataFrame, least: int, gram: int) -> DataFrame:
    """``gram``, ``id``, ``pos`` of every minimiser."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, flat, starts, ends in _parts(batches):
            at, grams = minimisers(flat, starts, ends, gram, least - gram + 1)
            owner = np.searchsorted(ends, at, "right")
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(grams.view(np.int64)), pa.array(ids[owner], pa.int64()),
                pa.array((at - starts[owner]).astype(np.int32))], names=["gram", "id", "pos"])

    return hashed.mapInArrow(tidied(run), "gram BIGINT, id BIGINT, pos INT")


def _contexts(hashed: DataFrame, places: DataFrame, least: int, gram: int) -> DataFrame:
    """Suffix rows with the words around them: ``left`` and ``right`` as four bytes per word.

    ``left`` runs from the suffix backwards, ``right`` from the end of the gram on; both hold
    ``least - gram`` words, and beyond the text a mark of their own that equals nothing.
    """
    side = least - gram
    rows = hashed.join(places, "id").select("id", "h", "at")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, flat, starts, ends in _parts(batches):
            lists = part.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            items = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            pos = items.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            grams = items.field("gram").to_numpy(zero_copy_only=False)
            runs = items.field("run").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            # The top bit tells words from marks; a mark holds the place it stands for.
            small = ((flat >> np.uint64(32)) | np.uint64(1 << 31)).astype(np.uint32)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(pos), 20_000):
                o, p = owner[a:a + 20_000], pos[a:a + 20_000]
                base = starts[o] + p
                steps = np.arange(side)
                back = base[:, None] - 1 - steps
                ahead = base[:, None] + gram + steps
                own = (ids[o].astype(np.uint64)[:, None] * np.uint64(1 << 20) + p.astype(np.uint64)[:, None])
                mark = ((_mix(own) & np.uint64(0x7FFFFFFF)).astype(np.uint32))
                sides = []
                for where, within in ((back, back >= starts[o][:, None]), (ahead, ahead < ends[o][:, None])):
                    words = np.where(within, small[np.clip(where, 0, max(0, len(small) - 1))], mark)
                    sides.append(np.ascontiguousarray(words, ">u4"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(grams[a:a + 20_000], pa.int64()), pa.array(ids[o], pa.int64()),
                    pa.array(p.astype(np.int32)),
                    pa.array([r.tobytes() for r in sides[0]], pa.binary()),
                    pa.array([r.tobytes() for r in sides[1]], pa.binary()),
                    pa.array(runs[a:a + 20_000], pa.int32()),
                ], names=["gram", "id", "pos", "left", "right", "run"])

    return rows.mapInArrow(tidied(run), "gram BIGINT, id BIGINT, pos INT, left BINARY, right BINARY, run INT")


def _neighbours(gram, ids, pos, left, right, side: int):
    """Texts of ``least`` words around each suffix that occur twice or more among these rows.

    Yields, per number of words to the left: the rows that have such a text, in the order that puts
    equal texts together, the earliest first; where equal texts start; and the texts' 64-bit hashes.
    """
    import numpy as np

    before = [gram]
    for j in range(side):
        before.append(_joined(before[-1], left[:, j].astype(np.uint64)))
    after = [np.zeros(len(gram), np.uint64)]
    for j in range(side):
        after.append(_joined(after[-1] + np.uint64(1), right[:, j].astype(np.uint64)))
    # The top bit parts words from marks beyond the text; a text with a mark in it is none.
    has_left, has_right = (left >= 1 << 31).sum(1), (right >= 1 << 31).sum(1)
    for j in range(side + 1):
        rows = np.flatnonzero((has_left >= j) & (has_right >= side - j))
        text = _mix(before[j][rows] ^ (after[side - j][rows] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)))
        order = np.lexsort((pos[rows], ids[rows], text))
        text, placed = text[order], rows[order]
        start = np.ones(len(order), bool)
        start[1:] = text[1:] != text[:-1]
        # A row that is given twice, or whose key is, has the same text at the same place once.
        again = np.zeros(len(order), bool)
        again[1:] = ~start[1:] & (ids[placed[1:]] == ids[placed[:-1]]) & (pos[placed[1:]] == pos[placed[:-1]])
        yield j, placed[~again], start[~again], text[~again]


def _repeats(sorted_rows: DataFrame, side: int) -> DataFrame:
    """Sorted suffixes to masks of repeated texts.

    ``repeated`` and ``late`` have bit j set if the text that starts j words left of ``pos`` occurs
    again, and if it is not its earliest occurrence. Rows with a ``text`` come from grams of several
    runs: the first occurrence of each text among the rows at hand, with the number of its
    occurrences there, to be compared with other runs.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["id", "pos", "repeated", "late", "text", "j", "seen"]

        def matrix(column, rows):
            return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(rows, -1)

        def work(tables):
            table = pa.Table.from_batches(tables).combine_chunks()
            count = table.num_rows
            gram = table.column(0).to_numpy().view(np.uint64)
            ids, pos = table.column(1).to_numpy(), table.column(2).to_numpy()
            left, right = (matrix(table.column(c), count) for c in (3, 4))
            border = table.column(5).to_numpy() >= 0
            repeated, late = np.zeros(count, np.int64), np.zeros(count, np.int64)
            firsts = []
            for j, order, start, text in _neighbours(gram, ids, pos, left, right, side):
                if not len(order):
                    continue
                run_of = np.cumsum(start) - 1
                sizes = np.bincount(run_of)
                many = sizes[run_of] > 1
                repeated[order[many]] |= 1 << j
                late[order[many & ~start]] |= 1 << j
                kept = np.flatnonzero(start & border[order])
                rows = order[kept]
                firsts.append((ids[rows], pos[rows], text[kept].view(np.int64),
                               np.full(len(rows), j, np.int32), sizes[run_of[kept]]))
            keep = np.flatnonzero(repeated)
            if len(keep):
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[keep], pa.int64()), pa.array(pos[keep], pa.int32()),
                    pa.array(repeated[keep]), pa.array(late[keep]), pa.nulls(len(keep), pa.int64()),
                    pa.nulls(len(keep), pa.int32()), pa.nulls(len(keep), pa.int64())], names=names)
            for i, p, t, j, s in firsts:
                if len(i):
                    zero = np.zeros(len(i), np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(i, pa.int64()), pa.array(p, pa.int32()), pa.array(zero), pa.array(zero),
                        pa.array(t), pa.array(j), pa.array(s.astype(np.int64))], names=names)

        held, rows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, parts = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            change = np.ones(batch.num_rows, bool)
            change[1:] = (grams[1:] != grams[:-1]) | (parts[1:] != parts[:-1])
            change[0] = last is not None and last != (grams[0], parts[0])
            last = (grams[-1], parts[-1])
            cuts = np.flatnonzero(change)
            if rows + batch.num_rows >= HELD_ROWS and len(cuts):
                at = int(cuts[-1])  # the last run may go on in the next batch
                if rows + at:
                    yield from work([*held, batch.slice(0, at)] if at else held)
                held, rows, batch = [], 0, batch.slice(at)
            held.append(batch)
            rows += batch.num_rows
        if rows:
            yield from work(held)

    return sorted_rows.mapInArrow(
        tidied(run), "id BIGINT, pos INT, repeated BIGINT, late BIGINT, text BIGINT, j INT, seen BIGINT")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   least: int = LEAST_WORDS, gram: int = GRAM) -> DataFrame:
    """Repeated passages: one row per span with ``key``, ``start_word``, ``end_word``, ``late``.

    A span is the union of overlapping runs of ``least`` words that occur elsewhere too, in another
    document or at another place of the same one. With ``late`` true it is the union of those runs
    that are not the earliest occurrence by (key, place), so taking the late spans away leaves one
    copy of every repeat. Words are counted from 0, the end is not included.

    Documents that are null, blank or shorter than ``least`` words, and rows with a null key, have no
    spans. Rows that share a key count as one document, whose words at a place may differ: the same
    passage at the same place of them is one occurrence, so a row given twice is no repeat. All words of all texts are compared, and
    words by 32 bits of their hash beyond a shared run of ``gram`` words.
    """
    side = least - gram
    if not 0 < gram < least or side > 60:
        raise ValueError("gram must be shorter than least, by 60 words at most")
    hashed = _word_hashes(docs.where(F.col(key).isNotNull()), key, text)
    suffixes = stored(_suffixes(hashed, least, gram), "suffix-places")
    shared = stored(suffixes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "suffix-grams")
    # Grams of several runs are few: where their number allows, their suffixes stay where they are,
    # and only the others meet by gram.
    common = small_side(stored(shared.where(F.col("n") > RUN_ROWS), "suffix-common"))
    run = F.pmod(F.xxhash64("id", "pos"), F.ceil(F.col("n") / RUN_ROWS).cast("int")).cast("int")
    others = suffixes.join(common.select("gram"), "gram", "left_anti").join(
        shared.where(F.col("n") <= RUN_ROWS).select("gram"), "gram").withColumn("run", F.lit(-1))
    dealt = others.select("id", "pos", "gram", "run").union(
        suffixes.join(common, "gram").select("id", "pos", "gram", run.alias("run")))
    places = stored(dealt.groupBy("id").agg(
        F.collect_list(F.struct("pos", "gram", "run")).alias("at")), "suffix-shared")
    rows = _contexts(hashed, places, least, gram)
    ordered = rows.repartition("gram", "run").sortWithinPartitions("gram", "run", "right", "id", "pos")
    found = stored(_repeats(ordered, side), "suffix-repeats")
    border = found.where("text IS NOT NULL")
    whole = border.groupBy("text").agg(F.sum("seen").alias("all"), F.min(F.struct("id", "pos")).alias("first"))
    bit = F.expr("shiftleft(1L, j)")
    met = border.join(whole, "text").where("all > 1").select(
        "id", "pos", bit.alias("repeated"),
        F.when(F.struct("id", "pos") != F.col("first"), bit).otherwise(0).cast("bigint").alias("late"))
    masks = found.where("text IS NULL").select("id", "pos", "repeated", "late").union(met)

    def spans(mask: str, late: bool) -> DataFrame:
        top = F.floor(F.log2(F.col(mask).cast("double"))).cast("int")
        low = F.floor(F.log2(F.expr(f"{mask} & -{mask}").cast("double"))).cast("int")
        runs = masks.where(F.col(mask) > 0).groupBy("id").agg(F.array_sort(F.collect_set(F.struct(
            (F.col("pos") - top).alias("a"), (F.col("pos") - low + least).alias("b")))).alias("runs"))
        # Runs are in the order of their starts: each joins the span before it or opens a new one.
        merged = F.aggregate(
            "runs", F.expr("cast(array() as array<struct<a:int,b:int>>)"),
            lambda acc, r: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= r["a"]),
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
                    F.element_at(acc, -1)["a"].alias("a"),
                    F.greatest(F.element_at(acc, -1)["b"], r["b"]).alias("b"))))
            ).otherwise(F.concat(acc, F.array(r))))
        return runs.select("id", F.explode(merged).alias("s")).select(
            F.col("id").alias(key), F.col("s.a").alias("start_word"), F.col("s.b").alias("end_word"),
            F.lit(late).alias("late"))

    return spans("repeated", False).union(spans("late", True))


def without_late_spans(docs: DataFrame, key: str = "doc_id", text: str = "text",
                       least: int = LEAST_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with every repeated passage cut out but its earliest copy.

    A cut takes the words of the span and the white space after them. Documents without late spans
    keep their text to the letter; documents of which no word is left are dropped. Rows with a null
    key, and null or blank texts, stay as they are. Columns and types are those of ``docs``.
    """
    import re

    late = repeated_spans(docs, key, text, least, gram).where("late").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("s"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col(key).cast("bigint").alias("k")).join(
        late.select(F.col(key).alias("k"), "s"), "k", "left")
    pattern = BLANK_PATTERN

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        word = re.compile("[^" + pattern[1:-2] + "]+")
        out = []
        for value, taken in zip(texts, spans):
            if taken is None or not len(taken) or value is None:
                out.append(value)
                continue
            starts = [m.start() for m in word.finditer(value)] + [len(value)]
            kept, at = [], 0
            for span in taken:
                a = starts[min(span["start_word"], len(starts) - 1)]
                b = starts[min(span["end_word"], len(starts) - 1)]
                kept.append(value[at:max(at, a)])
                at = max(at, b)
            kept.append(value[at:])
            out.append("".join(kept))
        return pd.Series(out, dtype=object)

    touched = packed.where("s IS NOT NULL").withColumn("t", cut(F.col(f"row.`{text}`"), F.col("s"))).where(
        F.size(words_of(F.col("t"))) > 0)
    whole = packed.where("s IS NULL").withColumn("t", F.col(f"row.`{text}`"))
    both = whole.union(touched)
    return both.select(*[F.col("t").alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns])
