"""Lookups, filters, orders and counts over verses v, books b and the lexicon x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as fn

KEY = ["engs", "chap", "sec"]


def chapter_verses(v: DataFrame, engs: str, chap: int) -> DataFrame:
    return v.where((F.col("engs") == engs) & (F.col("chap") == chap)).select("sec", "txt").orderBy("sec")


def verse_lookup(v: DataFrame, engs: str, chap: int, sec: int) -> DataFrame:
    return v.where((F.col("engs") == engs) & (F.col("chap") == chap) & (F.col("sec") == sec)).select(*KEY, "txt")


def book_verses(v: DataFrame, engs: str) -> DataFrame:
    return v.where(F.col("engs") == engs).select("chap", "sec", "txt").orderBy("chap", "sec")


def chapter_head(v: DataFrame, engs: str, chap: int, n: int = 5) -> DataFrame:
    """The first verses of a chapter, all columns."""
    return v.where((F.col("engs") == engs) & (F.col("chap") == chap)).orderBy("sec").limit(n)


def keyword_verses(v: DataFrame, key: str) -> DataFrame:
    """Verses that contain a text as it stands."""
    return v.where(F.contains(F.col("txt"), F.lit(key))).select(*KEY, "txt")


def tagged_verses(v: DataFrame) -> DataFrame:
    return v.where(fn.has_loose_tag(F.col("txt"))).select(*KEY)


def untagged_residual(v: DataFrame) -> DataFrame:
    """Verses with no well-formed tag, null texts among them."""
    return v.where(~fn.has_tag(F.col("txt"))).select(*KEY, "txt")


def _only(lang: str) -> Column:
    other = "G" if lang == "H" else "H"
    return fn.has_loose_tag(F.col("txt")) & ~F.col("txt").rlike(other + "[0-9]{3,5}>")


def tagged_only(v: DataFrame, lang: str) -> DataFrame:
    """Tagged verses without a tag of the other language; a verse with both is in neither result."""
    return v.where(_only(lang)).select(*KEY)


def tag_line_counts(v: DataFrame) -> DataFrame:
    """The three counts in one pass."""
    return v.agg(
        F.count_if(fn.has_loose_tag(F.col("txt"))).alias("n_tagged"), F.count_if(_only("H")).alias("n_only_h"), F.count_if(_only("G")).alias("n_only_g")
    )


def canonical_join(v: DataFrame, b: DataFrame) -> DataFrame:
    """Verses with their book's place; verses of unknown books drop out. The planner broadcasts the book table while it is small."""
    return v.join(b, "engs").select("id", *KEY, "txt")


def corpus_in_order(v: DataFrame, b: DataFrame) -> DataFrame:
    return canonical_join(v, b).orderBy("id", "chap", "sec")


def books_in_order(b: DataFrame) -> DataFrame:
    return b.select("engs", "id").orderBy("id")


def books_ordered_by_subquery(v: DataFrame, b: DataFrame) -> DataFrame:
    """The books that occur; unknown ones come first, as nulls do."""
    return v.select("engs").distinct().join(b, "engs", "left").select("engs", "id").orderBy(F.col("id").asc_nulls_first())


def verses_per_chapter(v: DataFrame) -> DataFrame:
    return v.groupBy("engs", "chap").agg(F.count("*").alias("n_verses"))


def chapters_per_book(v: DataFrame, b: DataFrame) -> DataFrame:
    """The greatest chapter number of each book, which is no count of chapters."""
    return v.join(b, "engs").groupBy("id", "engs").agg(F.max("chap").alias("max_chap")).orderBy("id")


def bare_group_column(v: DataFrame, b: DataFrame) -> DataFrame:
    """Groups by book and chapter with the book's id, which the book determines."""
    return v.join(b, "engs").groupBy("engs", "chap").agg(F.any_value("id").alias("book_id"), F.count("*").alias("n_verses"))


def distinct_books(v: DataFrame) -> DataFrame:
    return v.select("engs").distinct()


def distinct_chapters(v: DataFrame, engs: str) -> DataFrame:
    return v.where(F.col("engs") == engs).select("chap").distinct()


def schema_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table and column its place, type, rows and nulls; one pass over each table."""
    parts = []
    for name, df in sorted(tables.items()):
        cols = F.array(
            *[
                F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(F.col(f.name).isNull()).alias("n_null"))
                for i, f in enumerate(df.schema.fields)
            ]
        )
        one = df.agg(F.count("*").alias("n_rows"), cols.alias("c"))
        parts.append(one.select(F.lit(name).alias("table_name"), "n_rows", F.explode("c").alias("c")).select("table_name", "c.*", "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
