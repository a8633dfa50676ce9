"""Lexicon lookups, ranges, gaps and exports. x holds dic_type (1 for H, 0 for G), sn, num, orig, orig_alt, txt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.numbering import numbered

DIC_TYPE = {"ot": 1, "nt": 0}


def _check(a: int, b: int) -> None:
    if b <= a:
        raise ValueError("the end of a range must exceed its start")


def lexicon_entry(x: DataFrame, sn: str, mode: str = "ot") -> DataFrame:
    """The entry of a key; no row if there is none."""
    return x.where((F.col("sn") == sn) & (F.col("dic_type") == DIC_TYPE[mode])).select("sn", "orig", "txt")


def lexicon_range(x: DataFrame, a: int, b: int, mode: str = "ot") -> DataFrame:
    """Entries whose number lies from a to b, both included, letters or not."""
    return _in_range(x, a, b, mode).select("sn", "num", "orig", "txt")


def _in_range(x: DataFrame, a: int, b: int, mode: str) -> DataFrame:
    _check(a, b)
    return x.where(F.col("num").between(a, b) & (F.col("dic_type") == DIC_TYPE[mode]))


def lexicon_by_testament(x: DataFrame, mode: str = "ot") -> DataFrame:
    return x.where(F.col("dic_type") == DIC_TYPE[mode]).select("sn", "dic_type", "orig")


def lexicon_projection(x: DataFrame) -> DataFrame:
    return x.select("sn", F.col("txt").alias("dic_text"), "dic_type", "orig")


def lexicon_range_probe(x: DataFrame, a: int, b: int, mode: str = "ot") -> DataFrame:
    """Every number of the range with its plain entry, or null."""
    _check(a, b)
    asked = x.sparkSession.range(a, b + 1).select(F.col("id").cast("int").alias("num"))
    plain = x.where((F.col("dic_type") == DIC_TYPE[mode]) & (F.length("sn") == 5)).select("num", "sn", "orig")
    return asked.join(plain, "num", "left")


def lexicon_gaps(x: DataFrame, a: int, b: int, mode: str = "ot") -> DataFrame:
    """Numbers of the range without a plain entry; one with a letter does not fill a gap."""
    _check(a, b)
    asked = x.sparkSession.range(a, b + 1).select(F.col("id").cast("int").alias("num"))
    return asked.join(x.where((F.col("dic_type") == DIC_TYPE[mode]) & (F.length("sn") == 5)), "num", "left_anti")


def lexicon_suffix_probe(x: DataFrame, a: int, b: int, mode: str = "ot") -> DataFrame:
    """The plain key and those with a and b of every number, where they exist."""
    _check(a, b)
    asked = x.sparkSession.range(a, b + 1).select("id", F.explode(F.array(*[F.lit(s) for s in ("", "a", "b")])).alias("suffix"))
    keys = asked.select(F.col("id").cast("int").alias("num"), "suffix", F.concat(F.lpad(F.col("id").cast("string"), F.greatest(F.length(F.col("id").cast("string")), F.lit(5)), F.lit("0")), "suffix").alias("sn"))
    return keys.join(x.where(F.col("dic_type") == DIC_TYPE[mode]).select("sn", "orig"), "sn").select("num", "suffix", "sn", "orig")


def lexicon_natural_order(x: DataFrame) -> DataFrame:
    """Entries of each lexicon by number, then key, with their place."""
    return numbered(x.select("dic_type", "num", "sn"), "dic_type", ["num", "sn"], "place")


def lexicon_text_order(x: DataFrame) -> DataFrame:
    """Entries of each lexicon by key, with their place."""
    return numbered(x.select("dic_type", "sn"), "dic_type", ["sn"], "place")


def lexicon_counts(x: DataFrame) -> DataFrame:
    return x.groupBy("dic_type").agg(F.count("*").alias("n_entries"))


def record_json() -> Column:
    """An entry as the exported JSON record."""
    fields = F.struct("sn", F.col("txt").alias("dic_text"), "dic_type", "orig")
    return F.to_json(fields, {"ignoreNullFields": "false"})


def lexicon_array(x: DataFrame, a: int, b: int, mode: str = "ot") -> DataFrame:
    """The range as one JSON array in natural order; null if it is empty."""
    rows = _in_range(x, a, b, mode)
    items = F.transform(F.sort_array(F.collect_list(F.struct("num", "sn", record_json().alias("j")))), lambda e: e["j"])
    return rows.agg(items.alias("i")).select(F.when(F.size("i") > 0, F.concat(F.lit("["), F.array_join("i", ","), F.lit("]"))).alias("doc"))


def record_envelope(x: DataFrame, width: int = 100) -> DataFrame:
    """Envelopes with count and records in natural order, one for each ``width`` numbers of a lexicon."""
    grouped = x.groupBy("dic_type", F.floor(F.col("num") / width).cast("int").alias("part")).agg(
        F.count("*").alias("record_count"), F.sort_array(F.collect_list(F.struct("num", "sn", record_json().alias("j")))).alias("r")
    )
    body = F.concat(F.lit('{"record_count":'), F.col("record_count").cast("string"), F.lit(',"record":['), F.array_join(F.transform("r", lambda e: e["j"]), ","), F.lit("]}"))
    return grouped.select("dic_type", "part", "record_count", body.alias("doc"))


def lexicon_union(ot: DataFrame, nt: DataFrame) -> DataFrame:
    return ot.withColumn("dic_type", F.lit(1)).unionByName(nt.withColumn("dic_type", F.lit(0)))


def lexicon_append(x: DataFrame, mode: str = "ot") -> DataFrame:
    """Plain and lettered entries appended, each with its place in the number's group: plain, a, b."""
    own = x.where(F.col("dic_type") == DIC_TYPE[mode]).select("num", "sn", "orig")
    plain = own.where(F.length("sn") == 5).withColumn("place", F.lit(0))
    lettered = own.where(F.length("sn") > 5).withColumn("place", F.when(F.endswith(F.col("sn"), F.lit("a")), 1).otherwise(2))
    return plain.unionByName(lettered)


def tag_definitions(tags: DataFrame, x: DataFrame) -> DataFrame:
    """Distinct tags (lang, num) with all entries of their number and how many there are; tags without an entry keep null."""
    entries = x.select((F.when(F.col("dic_type") == 1, "H").otherwise("G")).alias("lang"), "num", "sn", "orig")
    counts = entries.groupBy("lang", "num").agg(F.count("*").alias("n_entries"))
    return tags.select("lang", "num").distinct().join(entries, ["lang", "num"], "left").join(counts, ["lang", "num"], "left").select("lang", "num", "sn", "orig", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))
