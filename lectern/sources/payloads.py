"""Landed API payloads, one JSON text per row, to flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.schemas import CHAPTER_PAYLOAD, LEXICON_PAYLOAD, VERSIONS_PAYLOAD


def flatten_chapter_payload(payloads: DataFrame) -> DataFrame:
    """(engs, chap, payload) to one row per verse record."""
    return payloads.select("engs", "chap", F.explode(F.from_json("payload", CHAPTER_PAYLOAD)["record"]).alias("r")).select("engs", "chap", "r.sec", "r.bible_text")


def flatten_lexicon_payload(payloads: DataFrame) -> DataFrame:
    """The first record of each successful response; missing fields are null."""
    p = payloads.select(F.from_json("payload", LEXICON_PAYLOAD).alias("p")).where("p.status = 'success'")
    return p.select(F.get(F.col("p.record"), F.lit(0)).alias("r")).select("r.sn", "r.dic_text", "r.edic_text", "r.orig")


def payload_success_count(payloads: DataFrame) -> DataFrame:
    status = F.from_json("payload", LEXICON_PAYLOAD)["status"]
    return payloads.agg(F.count_if(status == "success").alias("success_count"), F.count("*").alias("n_responses"))


def versions_with_tags(payloads: DataFrame) -> DataFrame:
    rows = payloads.select(F.explode(F.from_json("payload", VERSIONS_PAYLOAD)["record"]).alias("r")).select("r.*")
    return rows.where("strong = 1").select("version", "n_verses")


def chapter_payloads(v: DataFrame) -> DataFrame:
    """Verses as landed chapter responses."""
    records = F.sort_array(F.collect_list(F.struct("sec", F.col("txt").alias("bible_text"))))
    return v.groupBy("engs", "chap").agg(F.to_json(F.struct(records.alias("record")), {"ignoreNullFields": "false"}).alias("payload"))


def lexicon_payloads(x: DataFrame, keys: DataFrame) -> DataFrame:
    """A response for each asked key (num): status success with the plain H entry, or an error."""
    plain = x.where("dic_type = 1 AND length(sn) = 5").select("num", "sn", "txt", "orig")
    both = keys.join(plain, "num", "left")
    record = F.array(F.struct("sn", F.col("txt").alias("dic_text"), F.col("orig")))
    return both.select("num", F.to_json(F.struct(F.when(F.col("sn").isNull(), "error").otherwise("success").alias("status"), F.when(F.col("sn").isNotNull(), record).alias("record"))).alias("payload"))


def versions_payload(versions: DataFrame) -> DataFrame:
    """The version list as one response, with a tag flag for each; as many records as versions."""
    from lectern.functions.text import has_tag

    rows = versions.groupBy("version").agg(F.max(has_tag(F.col("txt")).cast("int")).alias("strong"), F.count("*").alias("n_verses"))
    return rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("version", "strong", "n_verses"))).alias("record"))).alias("payload"))
