"""Writing and reading corpus and lexicon exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.lexicon import lexicon_range
from lectern.operators.nesting import book_documents
from lectern.schemas import BOOK_DOCUMENT


def write_corpus_json(v: DataFrame, b: DataFrame, version: str, path: str) -> None:
    """One JSON line per book, below a folder for the version; null texts stay."""
    books = book_documents(v, b).select(F.lit(version).alias("version"), "engs", "chapters")
    books.write.mode("append").option("ignoreNullFields", "false").partitionBy("version").json(path)


def read_corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """The export as flat verses."""
    books = spark.read.schema(f"{BOOK_DOCUMENT}, version string").json(path)
    chapters = books.select("version", "engs", F.explode("chapters").alias("c"))
    return chapters.select("version", "engs", "c.chap", F.explode("c.verses").alias("v")).select("version", "engs", "chap", "v.sec", "v.txt")


def write_lexicon_json(x: DataFrame, a: int, b: int, mode: str, path: str) -> bool:
    """Writes a range as JSON lines; nothing at all for an empty one. True if written."""
    rows = lexicon_range(x, a, b, mode)
    if rows.isEmpty():
        return False
    rows.write.option("ignoreNullFields", "false").json(path)
    return True


def write_flat_listing(v: DataFrame, path: str) -> None:
    """Lines engs|chap|sec|txt."""
    v.select(F.concat_ws("|", "engs", F.col("chap").cast("string"), F.col("sec").cast("string"), F.coalesce("txt", F.lit(""))).alias("value")).write.text(path)
