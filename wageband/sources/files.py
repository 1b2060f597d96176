"""Small file operations through Spark's own file systems: listing, and writing a file just once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    place, files = _place(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing this folder."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def rename(spark: SparkSession, path: str, name: str) -> None:
    """Give a file another name in its folder."""
    place, files = _place(spark, path)
    if not files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), name)):
        raise FileExistsError(f"{path} cannot be called {name}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    place, files = _place(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody has written yet; false if it is there.

    The text is written to a file of its own, which then takes the name in one step that fails if
    the name is taken: readers see the whole file or none, and one of several writers wins.
    """
    place, files = _place(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    try:
        if files.getScheme() == "file":
            # A rename on one machine takes the place of a file that is there; a link does not.
            nio = spark._jvm.java.nio.file
            local = [nio.Path.of(spark._jvm.java.net.URI(files.makeQualified(p).toUri().toString()))
                     for p in (place, draft)]
            try:
                nio.Files.createLink(*local)
            except Exception as problem:
                if "FileAlreadyExists" in str(problem):
                    return False
                raise
            return True
        return bool(files.rename(draft, place)) if not files.exists(place) else False
    finally:
        files.delete(draft, False)
