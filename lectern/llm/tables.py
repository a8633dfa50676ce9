"""Intermediate tables in the folder that all executors share, and samples for training."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is sent to all executors up to so many rows of a few numbers each, about 30 MB; beyond that it is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and Spark runs in one process, as in tests, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="lectern-")
        shared_folder.own = folder
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back. Lineage ends here, so a lost executor costs a file read, not the work before."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table, written and counted, with a broadcast hint if it has at most ``limit`` rows."""
    df = written(df, "side")
    return F.broadcast(df) if df.count() <= limit else df


def sampled(rows: DataFrame, key: str, text: str, limit: int, limit_bytes: int, by: str | None = None) -> pd.DataFrame:
    """Whole rows for training: at most ``limit`` and together at most ``limit_bytes`` of text, both for each value of ``by`` if it is given.

    Rows are taken in the order of a hash of their key, equal ones once, so that each run takes the same. ``rows`` is read twice and should be few already;
    only numbers are sorted."""
    keys = [by, key] if by else [key]
    slim = rows.select(*keys, F.xxhash64(text).alias("_text"), F.octet_length(text).alias("_bytes")).distinct()
    window = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(F.xxhash64(key), key, "_text")
    ranked = slim.select("*", F.row_number().over(window).alias("_rank"), F.sum("_bytes").over(window).alias("_total"))
    taken = written(ranked.where(F.col("_rank").between(1, limit) & (F.coalesce("_total", F.lit(0)) <= limit_bytes)).select(*keys, "_text"), "sample")
    found = rows.withColumn("_text", F.xxhash64(text)).join(F.broadcast(taken), [*keys, "_text"], "left_semi").dropDuplicates([*keys, "_text"])
    return found.drop("_text").toPandas().sort_values([*keys, text], ignore_index=True)
