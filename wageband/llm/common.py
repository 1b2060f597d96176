"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wageband.session import shared_folder

# White space of the word pattern [^\x20\x09-\x0D]+ (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
BLANK_PATTERN = "[\\x20\\x09-\\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text in order; empty for a null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_PATTERN))


def remainder(key: Column, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; -1 for a null key, so it is never held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)).cast("int"),
                      F.lit(-1))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs start from the files.

    This cuts the lineage: a lost executor costs the rereading of its files, not the work before.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of one short key that may be broadcast, some 8 MB.
MOST_BROADCAST_KEYS = 500_000


def small_side(keys: DataFrame, most: int = MOST_BROADCAST_KEYS) -> DataFrame:
    """Stored keys, marked for broadcast if their counted number allows it; else the join shuffles."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def tidied(run: Callable) -> Callable:
    """``run`` for mapInArrow, handing freed memory back to the machine when its task is done.

    A Python worker outlives its tasks, and the C library keeps what they have freed.
    """
    def whole(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library, which has no such call

    return whole


# Characters of text worked on at once inside a task.
SLICE_CHARS = 4_000_000


def with_arrow_columns(df: DataFrame, text: str, results: dict[str, str],
                       start: Callable[[], Callable], slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``df`` with columns worked out from its text column by Arrow batches.

    ``start()`` runs once per task and returns a function from a list of texts (None for null) to
    one list or array per result. Batches are cut so that about ``slice_chars`` characters, or one
    longer text, are worked on at once. Result columns replace input columns of the same name.
    """
    from pyspark.sql.types import StructType

    names = {r.lower() for r in results}
    kept = [c for c in df.columns if c.lower() not in names]
    fresh = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in results.items()))
    work = unused(df, "_text")
    rows = df.select(*[F.col(f"`{c}`") for c in kept],
                     F.col(f"`{text}`").cast("string").alias(work))
    schema = StructType([f for f in rows.schema.fields if f.name != work] + fresh.fields)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fresh.fields]
        of = start()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            first = 0
            while first < batch.num_rows:
                last, chars = first, 0
                while last < batch.num_rows and (last == first or chars + sizes[last] <= slice_chars):
                    chars += sizes[last]
                    last += 1
                part = batch.slice(first, last - first)
                out = of(part.column(part.num_columns - 1).to_pylist())
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                arrays += [o if isinstance(o, pa.Array) else pa.array(o, type=t)
                           for o, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                first = last

    return rows.mapInArrow(tidied(run), schema)
