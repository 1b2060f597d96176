"""Delimited text at the edges; stored tables are Parquet."""

from __future__ import annotations

import csv
import io
import logging
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wageband.operators.merge import POSITION
from wageband.schemas import NA_TOKENS, RAW_SCHEMA

# Separators tried on a header line.
SEPARATORS = [",", ";", "\t", "|"]
PROVENANCE = "source_batch_file"
# Order of the rows that were read: by file name, then by place in the file.
FILE_ORDER = [PROVENANCE, POSITION]
LOG = logging.getLogger(__name__)
_OPENED_AT_ONCE = 16
# A quote that is open for so many lines of a header was never meant to be closed.
_MOST_HEADER_LINES = 1_000


def _options(sep: str, multi_line: bool) -> dict[str, str]:
    # Quoted line breaks keep a file in one split; turn multi_line off for large plain files.
    return {"header": "true", "sep": sep, "multiLine": str(multi_line).lower(), "quote": '"',
            "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false"}


def _typed(column: str, dtype: T.DataType) -> Column:
    """Null tokens to null and texts to the declared type."""
    cell = F.when(~F.col(column).isin(NA_TOKENS), F.col(column))
    return cell if isinstance(dtype, T.StringType) else cell.try_cast(dtype)


def _type_of(column: str, schema: T.StructType | None) -> T.DataType:
    """Declared type, else text; a stored position is a number in any case."""
    if schema is not None and column in schema.fieldNames():
        return schema[column].dataType
    return T.LongType() if column == POSITION else T.StringType()


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Files behind paths, folders and patterns, in the order of their names; others are reported."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = {}
    for path in paths:
        place = hadoop.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        hits = list(files.globStatus(place) or [])
        if not hits:
            LOG.warning("left out, as nothing is there: %s", path)
        for hit in hits:
            inner = files.listStatus(hit.getPath()) if hit.isDirectory() else [hit]
            for file in inner:
                name = file.getPath().getName()
                if not file.isDirectory() and name[0] not in "._":
                    found[file.getPath().toString()] = name
    return sorted(found, key=lambda f: (found[f], f))


def _literal(path: str) -> str:
    """A path that readers do not take for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _first_record(spark: SparkSession, codecs, path: str) -> str | None:
    """The first record of a file: its lines up to the first that closes all quotes. Only these are read."""
    java = spark._jvm.java.io
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    except Exception as problem:
        LOG.warning("cannot be opened: %s (%s)", path, str(problem).split("\n")[0])
        return None
    try:
        codec = codecs.getCodec(place)
        plain = stream if codec is None else codec.createInputStream(stream)
        reader, lines, quotes = java.BufferedReader(java.InputStreamReader(plain, "UTF-8")), [], 0
        while (line := reader.readLine()) is not None:
            if lines or line.strip("\ufeff \t"):
                lines.append(line)
                quotes += line.count('"')
                if quotes % 2 == 0:
                    return "\n".join(lines).removeprefix("\ufeff")
                if len(lines) == _MOST_HEADER_LINES:
                    LOG.warning("a quote is never closed in the header of %s", path)
                    return None
        return None
    except Exception as problem:
        LOG.warning("cannot be read: %s (%s)", path, str(problem).split("\n")[0])
        return None
    finally:
        stream.close()


def _headers(spark: SparkSession, files: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first record; a file without one is left out.

    As the layout has to be known before the scan is planned, the driver opens the files, many at a
    time, and reads some kilobytes of each, however long they are.
    """
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    with ThreadPoolExecutor(_OPENED_AT_ONCE) as pool:
        records = list(pool.map(lambda f: _first_record(spark, codecs, f), files))
    by_header: dict[str, list[str]] = {}
    for file, header in zip(files, records):
        if header is None:
            LOG.warning("left out, as it is empty or cannot be read: %s", file)
        else:
            by_header.setdefault(header, []).append(file)
    return by_header


def _separator_of(header: str) -> str:
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s)))


def _names_of(header: str, sep: str) -> list[str]:
    """Column names of a header record; those that are empty or repeated get their number."""
    names = next(csv.reader(io.StringIO(header), delimiter=sep))
    lowered = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n
            for i, n in enumerate(names)]


def read_delimited(spark: SparkSession, path: str | Sequence[str],
                   schema: T.StructType | None = RAW_SCHEMA, sep: str | None = ",",
                   multi_line: bool = True) -> DataFrame:
    """Files, folders or patterns as one table, with position and file name.

    Files whose first record is the same are read by one scan, the scans are united by column name, and
    missing columns are null. Paths that do not exist and files without a header are left out with
    a warning; with none left the table is empty. ``sep=None`` looks at each header. The schema
    gives types by name. The file name is always the one read, whatever a file has stored under
    that name; a stored position is kept. Rows are in the order of ``FILE_ORDER``.
    """
    files = _files(spark, [path] if isinstance(path, str) else path)
    parts = [_read_alike(spark, alike, header, sep or _separator_of(header), schema, multi_line)
             for header, alike in _headers(spark, files).items()] if files else []
    if not parts:
        return spark.createDataFrame([], schema or T.StructType()).withColumns({
            PROVENANCE: F.lit(None).cast("string"), POSITION: F.lit(None).cast("bigint")})
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_alike(spark: SparkSession, files: Sequence[str], header: str, sep: str,
                schema: T.StructType | None, multi_line: bool) -> DataFrame:
    """Files with one header."""
    layout = T.StructType([T.StructField(n, T.StringType()) for n in _names_of(header, sep)])
    found = spark.read.schema(layout).options(
        **_options(sep, multi_line), ignoreCorruptFiles="true", ignoreMissingFiles="true").csv(
        [_literal(f) for f in files])
    cells = {c: _typed(c, _type_of(c, schema)) for c in found.columns}
    place = {POSITION: F.monotonically_increasing_id()} if POSITION not in cells else {}
    # The position rises within a file; the file name is the leading part of the order.
    # The name is given as it stands in an address.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return found.withColumns({**place, **cells, PROVENANCE: name})


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """Header, doubled quotes, blanks kept."""
    df.write.mode(mode).options(header="true", sep=sep, quote='"', escape='"', emptyValue="",
                                ignoreLeadingWhiteSpace="false",
                                ignoreTrailingWhiteSpace="false").csv(path)
