"""Session defaults for local runs, and the shared folder a cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", checkpoint_dir: str | None = None,
                  app: str = "wageband") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Plans here have hundreds of expressions; noting the Python line of each is slow.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run below the folder named in ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        # One machine, as in tests: any folder of it is shared.
        root = tempfile.mkdtemp(prefix="wageband-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"



def stored_rows(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows starts from the files."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
