"""Compare query results with the SQL oracle: row count, column types and order-free values."""

from __future__ import annotations

import math
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, db, query, sql: str, sf_dir: str) -> tuple[str, float]:
    """``ok`` or a short description of the first difference, and the Spark seconds."""
    start = time.time()
    frame = query(spark, sf_dir)
    ours = frame.collect()
    seconds = time.time() - start
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", seconds
    a, b = _rows(frame.columns, ours), _rows(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", seconds
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} rows differ, first {sorted(names)} {different[0]}", seconds
    short = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
             "BOOLEAN": "boolean"}
    types = {d[0]: short.get(str(d[1]), str(d[1])) for d in result.description}
    odd = {c: (t, types[c]) for c, t in frame.dtypes if types[c] != t}
    return ("ok" if not odd else f"ok, types differ {odd}"), seconds
