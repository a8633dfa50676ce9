"""Keyword search by an inverted index of character pairs.

A text that contains a key contains all pairs of neighbouring characters of the key. The index has, for each pair and chapter, the verses in
which it stands, in folders by a hash of the pair and sorted by pair inside. A search reads the lists of the key's rarest pairs only,
intersects them, and looks the key up in the texts of the verses that are left. A key of one character has no pair and is searched
in all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.lookup import keyword_verses

KEY = ["engs", "chap", "sec"]
BUCKETS = 64
#: Lists of so many pairs of a key are intersected, the rarest ones; the texts decide in the end.
PAIRS_USED = 4
POSTINGS = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("pair", T.StringType()),
        T.StructField("engs", T.StringType()),
        T.StructField("chap", T.IntegerType()),
        T.StructField("secs", T.ArrayType(T.IntegerType())),
    ]
)


def _bucket(pair: Column) -> Column:
    return F.pmod(F.xxhash64(pair), F.lit(BUCKETS)).cast("int")


def postings(v: DataFrame) -> DataFrame:
    """The index of verses (engs, chap, sec, txt): bucket, pair, engs, chap, secs. A chapter has one row per pair, so lists are as long as a chapter at most."""
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("txt") - 1), lambda i: F.substr(F.col("txt"), i, F.lit(2))))
    each = v.where("length(txt) > 1").select(*KEY, F.explode(pairs).alias("pair"))
    return each.groupBy("pair", "engs", "chap").agg(F.sort_array(F.collect_set("sec")).alias("secs")).select(_bucket(F.col("pair")).alias("bucket"), "pair", "engs", "chap", "secs")


def key_pairs(key: str) -> list[str]:
    return list(dict.fromkeys(key[i : i + 2] for i in range(len(key) - 1)))


def candidates(index: DataFrame, key: str) -> DataFrame:
    """Verses (engs, chap, sec) in which the key's rarest pairs all stand."""
    pairs, spark = key_pairs(key), index.sparkSession
    asked = spark.createDataFrame([(p,) for p in pairs], "pair string").select("pair", _bucket(F.col("pair")).alias("bucket"))
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    lists = index.where(F.col("bucket").isin(buckets) & F.col("pair").isin(pairs))
    # one row per pair of the key
    sizes = {r["pair"]: r["n"] for r in lists.groupBy("pair").agg(F.sum(F.size("secs")).alias("n")).collect()}
    if len(sizes) < len(pairs):
        return index.where("false").select("engs", "chap", F.explode("secs").alias("sec"))
    used = sorted(pairs, key=lambda p: (sizes[p], p))[:PAIRS_USED]
    own = {r["bucket"] for r in asked.where(F.col("pair").isin(used)).collect()}
    some = index.where(F.col("bucket").isin(sorted(own)) & F.col("pair").isin(used)).groupBy("engs", "chap").agg(F.collect_list("secs").alias("lists")).where(F.size("lists") == len(used))
    common = F.aggregate(F.slice("lists", 2, PAIRS_USED), F.get("lists", F.lit(0)), F.array_intersect)
    return some.select("engs", "chap", F.explode(common).alias("sec"))


def keyword_search(index: DataFrame | None, v: DataFrame, key: str) -> DataFrame:
    """Verses that contain the key as it stands, found through the index of the same verses, or in all texts where there is none. An empty key is in every text that is not null."""
    if index is None or len(key) < 2:
        return keyword_verses(v, key)
    return keyword_verses(v.join(candidates(index, key), KEY, "left_semi"), key)
