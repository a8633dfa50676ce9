"""Parallel versions of a corpus, joined verse by verse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn

KEY = ["engs", "chap", "sec"]


def parallel_verses(first: DataFrame, second: DataFrame) -> DataFrame:
    """The verses of the first version with the second's text, null where it has none."""
    return first.select(*KEY, F.col("txt").alias("txt_1")).join(second.select(*KEY, F.col("txt").alias("txt_2")), KEY, "left")


def chapter_requests(requests: DataFrame, v: DataFrame) -> DataFrame:
    """Requests (version, engs, chap) with the verses of their chapter."""
    return requests.join(v, ["version", "engs", "chap"]).select("version", *KEY, "txt")


def book_name_map(v: DataFrame, b: DataFrame) -> DataFrame:
    """Verse counts by book, joined over the slug of its name."""
    names = b.select("id", fn.book_slug(F.col("engs")).alias("slug"), F.col("engs").alias("display"))
    counts = v.groupBy("engs").agg(F.count("*").alias("n_verses")).select(fn.book_slug(F.col("engs")).alias("slug"), "n_verses")
    return names.join(counts, "slug").select("id", "slug", "display", "n_verses")


def original_pair(translation: DataFrame, original: DataFrame) -> DataFrame:
    """Verses on both sides, and those on one side only, with the side."""
    a, b = translation.select(*KEY, F.col("txt").alias("txt_t")), original.select(*KEY, F.col("txt").alias("txt_o"))
    both = a.withColumn("in_t", F.lit(True)).join(b.withColumn("in_o", F.lit(True)), KEY, "full")
    side = F.when(F.col("in_t") & F.col("in_o"), "both").when(F.col("in_t"), "translation").otherwise("original")
    return both.select(*KEY, side.alias("side"), "txt_t", "txt_o")


def tag_strip_check(tagged: DataFrame, plain: DataFrame) -> DataFrame:
    """Verses whose text without tags differs from the plain twin."""
    twin = plain.select(*KEY, F.col("txt").alias("plain"))
    return tagged.join(twin, KEY).where(~fn.strip_tags(F.col("txt")).eqNullSafe(F.col("plain"))).select(*KEY, "plain")


def versions_union(versions: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [v.select(F.lit(name).alias("version"), *KEY, "txt") for name, v in versions.items()])


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verses inserted, deleted or changed between two snapshots, with both texts."""
    a = old.select(*KEY, F.col("txt").alias("old_txt"), F.lit(True).alias("was"))
    b = new.select(*KEY, F.col("txt").alias("new_txt"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "insert").when(F.col("is").isNull(), "delete").when(~F.col("old_txt").eqNullSafe(F.col("new_txt")), "update")
    return a.join(b, KEY, "full").select(*KEY, change.alias("change"), "old_txt", "new_txt").where("change IS NOT NULL")


def chapter_has_annotations(annotated: DataFrame) -> DataFrame:
    """Whether a chapter's first verse has annotations."""
    return annotated.groupBy("engs", "chap").agg((F.min_by(F.size("strongs"), "sec") > 0).alias("annotated"))


def explode_annotations(annotated: DataFrame) -> DataFrame:
    return annotated.select(*KEY, F.posexplode("strongs").alias("place", "s")).select(*KEY, (F.col("place") + 1).alias("place"), "s.sn", "s.word")


def position_changes(events: DataFrame) -> DataFrame:
    """Events whose position differs from the one before in their session."""
    before = F.lag("k").over(Window.partitionBy("session").orderBy("ts", "event_id"))
    return events.withColumn("before", before).where(~F.col("k").eqNullSafe(F.col("before")) | F.col("before").isNull()).select("session", "event_id", "k")
