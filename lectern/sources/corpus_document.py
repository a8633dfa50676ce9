"""The whole corpus as one JSON document of any size, in ordered files.

The document is cut into lines, one for each chapter, with what opens and closes its book on the first and last of them, and a head and a
tail. Lines are dealt out by ranges of their place and written as text, so the files end to end, by name, are the document; line ends are
white space in JSON. No task holds more than a chapter at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.nesting import chapter_arrays

_NULLS = {"ignoreNullFields": "false"}


def _members(object_: Column) -> Column:
    """A JSON object without its braces."""
    return F.substr(object_, F.lit(2), F.length(object_) - 2)


def document_lines(v: DataFrame, b: DataFrame, version: str, producer: str) -> DataFrame:
    """Lines of the document: id, chap, line, and begin, the byte at which the line begins. The head has id null and chap 0, the tail chap 1.

    Books come by id, chapters by number. A corpus without books has null for them. Lengths are summed inside each book and then over the books, one number each."""
    chapters = chapter_arrays(v.join(b, "engs"), "id")
    books = chapters.groupBy("id", "engs").agg(F.min("chap").alias("first"), F.max("chap").alias("last"))
    # a book's id is its place; of two books with one id the names decide
    books = books.withColumn("is_first", F.struct("id", "engs") == F.min(F.struct("id", "engs")).over(Window.partitionBy()))
    opened = F.concat(F.when(F.col("is_first"), "").otherwise(","), F.lit("{"), _members(F.to_json(F.struct("engs"))), F.lit(',"chapters":['))
    before = F.when(F.col("chap") == F.col("first"), opened).otherwise(F.lit(","))
    after = F.when(F.col("chap") == F.col("last"), F.lit("]}")).otherwise(F.lit(""))
    line = F.concat(before, F.to_json(F.struct("chap", "verses"), _NULLS), after)
    named = books.select(F.col("id").alias("i"), F.col("engs").alias("e"), "first", "last", "is_first")
    body = chapters.join(named, (F.col("id") == F.col("i")) & (F.col("engs") == F.col("e"))).select("id", "engs", "chap", line.alias("line"))
    told = F.to_json(F.struct(F.lit(version).alias("version"), F.lit(producer).alias("producer")), _NULLS)
    head = F.concat(F.lit("{"), _members(F.col("told")), F.lit(',"text":'), F.when(F.col("n") > 0, "[").otherwise("null"))
    ends = books.agg(F.count("*").alias("n")).withColumn("told", told)
    ends = ends.select(F.explode(F.array(F.struct(F.lit(0).alias("chap"), head.alias("line")), F.struct(F.lit(1).alias("chap"), F.when(F.col("n") > 0, "]}").otherwise("}").alias("line")))).alias("x"))
    ends = ends.select(F.lit(None).cast("int").alias("id"), F.lit(None).cast("string").alias("engs"), "x.chap", "x.line", (F.col("x.chap") * 2).alias("part"))
    lines = body.withColumn("part", F.lit(1)).unionByName(ends)
    size = F.octet_length("line") + 1
    per_book = lines.groupBy("part", "id", "engs").agg(F.sum(size).alias("bytes"))
    over = Window.orderBy("part", "id", "engs")  # one row per book, and two
    starts = per_book.select(F.col("part").alias("p"), F.col("id").alias("i"), F.col("engs").alias("e"), (F.sum("bytes").over(over) - F.col("bytes")).alias("start"))
    same = (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("i")) & F.col("engs").eqNullSafe(F.col("e"))
    within = F.sum(size).over(Window.partitionBy("part", "id", "engs").orderBy("chap")) - size
    return lines.withColumn("within", within).join(F.broadcast(starts), same).select("part", "id", "engs", "chap", "line", (F.col("start") + F.col("within")).alias("begin"))


def write_corpus_document(v: DataFrame, b: DataFrame, version: str, producer: str, path: str) -> None:
    """The document below ``path/document``, and below ``path/places`` where each chapter's line begins and how many bytes it has."""
    lines = document_lines(v, b, version, producer)
    lines.repartitionByRange("part", "id", "engs", "chap").sortWithinPartitions("part", "id", "engs", "chap").select("line").write.text(f"{path}/document")
    lines.where("part = 1").select("id", "engs", "chap", "begin", F.octet_length("line").alias("bytes")).write.parquet(f"{path}/places")


def read_document_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path}/document")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, engs string, chap int, begin long, bytes int").parquet(f"{path}/places")
