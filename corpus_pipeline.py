"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes the documents that its predecessor kept and works on all of them;
``run`` writes them as Parquet in between, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, line_dedup, near_dedup, packing, quality
from lectern.llm.queries import table, word_tokenizer
from lectern.llm.tables import written

#: Near copies of this similarity of five-word shingles are dropped. A pair at 0.8 shares no band with probability 5e-5.
SIMILAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Each row is judged by its own text, also with a null or repeated doc_id; null and empty texts have the score of even odds, which the learned share
    of good documents decides. An empty table stays empty, and without labels every row has score 0.5 and stays. Extra columns are passed on."""
    return quality.with_score(docs, table(spark, sf_dir, "labels"), "_quality_score").where(F.col("_quality_score") >= quality.THRESHOLD).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines, and the documents of which no word is left; n_chars is counted anew.

    Null, empty and blank texts and rows without a doc_id stay as they are. Rows of one doc_id and one text are one document, so neither loses lines to the
    other. An empty table stays empty. Extra columns are passed on, also those named as the operator's own counts."""
    edited = line_dedup.edited_documents(docs, counts=("_stage_lines", "_stage_removed"))
    left = edited.where("_stage_removed = 0 OR text RLIKE '[^ \\\\t-\\\\r]'")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates, and one row of each doc_id.

    Null, empty and blank texts are like nothing and stay, as do rows without a doc_id. An empty table stays empty. Extra columns are passed on."""
    return near_dedup.one_of_each(docs, SIMILAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null, empty and short texts hold none. All rows of a doc_id go if one of them holds an item; rows without a doc_id stay. An empty table on either
    side drops nothing. Extra columns are passed on."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of token ids, one row each: sequence_id, n_tokens, doc_ids of its pieces in order, ids (little-endian unsigned
    32-bit numbers), and pieces (offset in the sequence, doc_id, piece, start in the document, length).

    A null, empty or blank text is one piece of the end id alone. Each row is packed, also with a null or repeated doc_id. An empty table gives no
    sequences. None of the documents' own columns are passed on."""
    packed = packing.pack_documents(docs, word_tokenizer())
    return packed.select("sequence_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.transform("pieces", lambda x: x["doc_id"]).alias("doc_ids"), "ids", "pieces")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


#: A fitted classifier and the choice of sequences are not SQL.
ORACLE_SQL = None
