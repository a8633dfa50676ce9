"""Benchmark decontamination: size-partitioned MinHash containment search, native DataFrame operations only.

Items are partitioned by the number of their shingles, in powers of two. An item
is searched by its MinHash sketch, the ``SKETCH`` least of its shingle hashes. In
a size class all sketch values lie below that class's greatest one, so a
document's sketch keeps its shingle hashes up to the greatest bound among the
classes that it is large enough to contain: a share of its shingles for large
items, more for small ones. An item is found however long the document is, unlike
by Jaccard similarity of whole signatures. A candidate is confirmed by
the exact containment of its full shingle set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.tables import sized, written

SHINGLE_WORDS = 5
PERCENT = 80
#: At containment 0.8 none of 8 sketch values is in the document with probability 3e-6.
SKETCH = 8
#: A table of items' hashes is sent to all executors up to so many rows; beyond that it is shuffled.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits, so that punctuation and case do not hide a copy."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """A hash of every ``size``-word window; an empty list for fewer words."""
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), window)).otherwise(F.array().cast("array<long>"))


def _hashed(table: DataFrame, key: str) -> DataFrame:
    # explode_outer in the callers: the optimizer adds a filter below explode, into which it would copy all of this
    worded = table.select(F.col(key).alias("key"), words_of(F.col("text")).alias("words"))
    return worded.select("key", shingles_of(F.col("words")).alias("hashes"))


def _sized(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) where a document holds at least that share of an item's distinct shingles.

    Items of fewer than five words have no shingle and match nothing here, see ``short_matches``; null or empty texts on either side match nothing. Rows without an id are
    left out, rows of one id are one document or item, repeated rows count once, and other columns are ignored."""
    items = _hashed(benchmark.where("item_id IS NOT NULL"), "item_id").select("key", F.explode_outer("hashes").alias("hash")).where("hash IS NOT NULL").distinct()
    sizes = items.groupBy("key").agg(F.count("*").alias("n_item"), F.sort_array(F.collect_list("hash")).alias("hashes"))
    items = written(sizes.where("n_item > 0"), "items").withColumn("class", F.floor(F.log2("n_item")).cast("int"))
    counted = items.select("key", "n_item", "class", F.explode(F.slice("hashes", 1, SKETCH)).alias("hash"))
    full = items.select(F.col("key").alias("item_id"), "n_item", F.explode("hashes").alias("hash"))
    # one row for each power of two that occurs
    classes = counted.groupBy("class").agg(F.max("hash").alias("bound"), F.min("n_item").alias("least"), F.count("*").alias("rows")).collect()
    rows = sum(c["rows"] for c in classes)
    whole = items.agg(F.sum("n_item")).first()[0] or 0

    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    large_enough = [F.when(F.col("size") >= F.lit(percent * c["least"] // 100), F.lit(c["bound"])) for c in classes]
    bound = F.greatest(*large_enough, F.lit(None).cast("long"), F.lit(None).cast("long"))
    hashed = _hashed(docs.withColumnRenamed("doc_id", "item_id"), "item_id").select("key", F.coalesce(F.size("hashes"), F.lit(0)).alias("size"), "hashes")
    sketched = hashed.select(F.col("key").alias("doc_id"), "size", bound.alias("bound"), F.explode_outer("hashes").alias("hash")).where("hash <= bound")
    candidates = (
        sketched.join(_sized(counted.select(F.col("key").alias("item_id"), "n_item", "hash"), rows), "hash")
        .where(100 * F.col("size") >= percent * F.col("n_item"))
        .groupBy("doc_id", "item_id")
        .count()
        .select("doc_id", "item_id")
    )
    candidates = written(candidates, "candidates")
    texts = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    exact = (
        _hashed(texts.withColumnRenamed("doc_id", "item_id"), "item_id")
        .select(F.col("key").alias("doc_id"), F.explode_outer(F.array_distinct("hashes")).alias("hash"))
        .join(_sized(full, whole), "hash")
        .select("doc_id", "item_id", "n_item", "hash")
        .distinct()
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.count("*").alias("n_shared"))
        .where(100 * F.col("n_shared") >= percent * F.col("n_item"))
    )
    return exact.join(candidates, ["doc_id", "item_id"], "left_semi").withColumn("containment", F.col("n_shared") / F.col("n_item"))


def short_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id, n_words) where a document holds all words of an item of one to four words, next to each other and whole.

    Such items have no shingle. They are compared as they stand, word by word: for each number of words that an item has, all runs of so many words of
    every document meet the items in a join. Without such items nothing of the documents is read. Nulls, repeats and ids as in ``contaminated``."""
    words = words_of(F.col("text"))
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words.alias("words")).where(F.size("words").between(1, SHINGLE_WORDS - 1))
    items = written(items.select("item_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("run")).distinct(), "short")
    sizes = {r["n_words"]: r["n"] for r in items.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return items.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", "n_words").where("false")
    run = lambda k: lambda i: F.struct(F.lit(k).alias("n_words"), F.array_join(F.slice("words", i, k), " ").alias("run"))
    runs = [F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), run(k))).otherwise(F.array().cast("array<struct<n_words:int,run:string>>")) for k in sorted(sizes)]
    worded = docs.where("doc_id IS NOT NULL").select("doc_id", words.alias("words")).select("doc_id", F.array_distinct(F.concat(*runs)).alias("runs"))
    each = worded.select("doc_id", F.explode_outer("runs").alias("r")).select("doc_id", "r.n_words", "r.run").where("run IS NOT NULL")
    return each.join(_sized(items, sum(sizes.values())), ["n_words", "run"]).select("doc_id", "item_id", "n_words").distinct()


def all_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminated``, and ``short_matches`` as a class of their own: whole_item is true for these. They have one piece, which is the whole item."""
    short = short_matches(docs, benchmark).select("doc_id", "item_id", F.lit(1).cast("long").alias("n_item"), F.lit(1).cast("long").alias("n_shared"), F.lit(1.0).alias("containment"), F.lit(True).alias("whole_item"))
    return contaminated(docs, benchmark).withColumn("whole_item", F.lit(False)).unionByName(short)


def decontaminated(docs: DataFrame, benchmark: DataFrame, short_items: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item. Rows without an id stay.

    Items of one to four words count only if ``short_items`` is given: so short a run of words stands in many clean documents."""
    found = contaminated(docs, benchmark).select("doc_id")
    if short_items:
        found = found.unionByName(short_matches(docs, benchmark).select("doc_id"))
    return docs.join(sized(found.distinct()), "doc_id", "left_anti").select(docs.columns)
