"""Explicit schemas of the data model; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = [T.StructField("engs", T.StringType()), T.StructField("chap", T.IntegerType()), T.StructField("sec", T.IntegerType())]

BOOKS = T.StructType([T.StructField("engs", T.StringType()), T.StructField("id", T.IntegerType())])
VERSES = T.StructType([T.StructField("version", T.StringType()), *KEY, T.StructField("txt", T.StringType())])
LEXICON = T.StructType(
    [
        T.StructField("dic_type", T.IntegerType()),
        T.StructField("sn", T.StringType()),
        T.StructField("num", T.IntegerType()),
        T.StructField("orig", T.StringType()),
        T.StructField("orig_alt", T.StringType()),
        T.StructField("txt", T.StringType()),
    ]
)
CHAPTER_PAYLOAD = "struct<record:array<struct<sec:int,bible_text:string>>>"
LEXICON_PAYLOAD = "struct<status:string,record:array<struct<sn:string,dic_text:string,edic_text:string,orig:string>>>"
VERSIONS_PAYLOAD = "struct<record:array<struct<version:string,strong:int,n_verses:bigint>>>"
BOOK_DOCUMENT = "engs string, chapters array<struct<chap:int,verses:array<struct<sec:int,txt:string>>>>"
READER_EVENTS = "event_id long, ts timestamp, session long, event string, k int"
