"""Folders for landed files, on storage that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def landing_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset and Spark runs in one process, as in tests, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(landing_base, "own", None) or tempfile.mkdtemp(prefix="lectern-landing-")
        landing_base.own = base
    return base.rstrip("/")


def landing_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``landing_base``."""
    return f"{landing_base(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes made inside remove their own shuffle files when they are done, which else stay until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back, which cuts its lineage."""
    path = landing_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
