"""Snapshots of a corpus with digests by chapter and book, so that two of them are compared from the top down.

A snapshot is a folder with ``verses`` in folders by book, sorted by chapter and verse, ``chapters`` with one digest per chapter, by book
too, and ``books`` with one per book. A digest is a sum of hashes, so it does not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.parallel import snapshot_diff

_VERSES = "engs string, chap int, sec int, txt string"
_CHAPTERS = "engs string, chap int, n long, digest decimal(38,0)"
_BOOKS = "engs string, n long, digest decimal(38,0)"
#: Up to so many books and chapters that differ are named in the filters of a scan, which then passes over folders and parts of files; beyond that only the join picks rows.
NAMED_BOOKS, NAMED_CHAPTERS = 500, 10_000


def _sum_of(*columns: Column) -> Column:
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("decimal(38,0)")


def write_snapshot(v: DataFrame, path: str) -> None:
    """Verses (engs, chap, sec, txt) and their digests. A null text counts as one, unlike an empty one."""
    spark = v.sparkSession
    ordered = v.select("engs", "chap", "sec", "txt").repartitionByRange("engs", "chap", "sec").sortWithinPartitions("engs", "chap", "sec")
    ordered.write.partitionBy("engs").parquet(f"{path}/verses")
    verses = spark.read.schema(_VERSES).parquet(f"{path}/verses")
    # a null and what it is replaced by are told apart by the second value
    text = (F.col("sec"), F.col("txt").isNull(), F.coalesce("txt", F.lit("")))
    chapters = verses.groupBy("engs", "chap").agg(F.count("*").alias("n"), _sum_of(*text).alias("digest"))
    chapters.repartition("engs").write.partitionBy("engs").parquet(f"{path}/chapters")
    books = spark.read.schema(_CHAPTERS).parquet(f"{path}/chapters").groupBy("engs").agg(F.sum("n").alias("n"), _sum_of(F.col("chap"), F.col("n"), F.col("digest")).alias("digest"))
    books.write.parquet(f"{path}/books")


def _differ(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks or whose digests differ."""
    side = lambda df, name: df.select(*keys, F.struct("n", "digest").alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = side(old, "x").alias("a").join(side(new, "y").alias("b"), same, "full")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys])


def _one_of(rows: DataFrame, names: list[str | None]) -> DataFrame:
    known = F.col("engs").isin([n for n in names if n is not None])
    return rows.where(known | F.col("engs").isNull() if None in names else known)


def differing_chapters(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Chapters (engs, chap) whose verses differ. Chapter digests are read of the books that differ only."""
    books = _differ(*(spark.read.schema(_BOOKS).parquet(f"{p}/books") for p in (old, new)), ["engs"])
    names = [r["engs"] for r in books.limit(NAMED_BOOKS + 1).collect()]
    sides = [spark.read.schema(_CHAPTERS).parquet(f"{p}/chapters") for p in (old, new)]
    if len(names) <= NAMED_BOOKS:
        sides = [_one_of(s, names) for s in sides]
    return _differ(*sides, ["engs", "chap"])


def stored_diff(spark: SparkSession, old: str, new: str) -> DataFrame:
    """What ``snapshot_diff`` gives for two written snapshots; only texts of chapters that differ are compared, and only their folders and parts of files read."""
    chapters = differing_chapters(spark, old, new)
    some = chapters.limit(NAMED_CHAPTERS + 1).collect()
    sides = [spark.read.schema(_VERSES).parquet(f"{p}/verses") for p in (old, new)]
    if len(some) <= NAMED_CHAPTERS:
        names, numbers = list({r["engs"] for r in some}), sorted({r["chap"] for r in some if r["chap"] is not None})
        bounds = F.col("chap").between(numbers[0], numbers[-1]) & F.col("chap").isin(numbers) if numbers else F.lit(False)
        if any(r["chap"] is None for r in some):
            bounds = bounds | F.col("chap").isNull()
        wanted = F.broadcast(spark.createDataFrame([(r["engs"], r["chap"]) for r in some], "e string, c int"))
        sides = [_one_of(s, names).where(bounds) for s in sides]
    else:
        wanted = chapters.select(F.col("engs").alias("e"), F.col("chap").alias("c"))
    mine = F.col("engs").eqNullSafe(F.col("e")) & F.col("chap").eqNullSafe(F.col("c"))
    return snapshot_diff(*(s.join(wanted, mine, "left_semi") for s in sides))
