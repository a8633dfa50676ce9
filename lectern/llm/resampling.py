"""Importance resampling of documents towards a target, by hashed word counts.

Each word, or run of words, falls into a bucket by its CRC-32. A bucket's gain compares its share
of the target with its share of the documents; a document weighs the sum of the gains of
its words, looked up in one array. Adding Gumbel noise to the weights and taking the greatest
is sampling without replacement (Efraimidis and Spirakis; Xie et al., 2023).

The greatest are found by a distributed radix sort, least significant digit first, over the
composite key (score from the greatest, doc_id, words). A pass has one counting sort: rows lie
in chunks of neighbouring positions; the digits of each chunk are counted; sums of the counts
over smaller digits and over the same digit in chunks before tell where the rows of a digit
and chunk begin; each row moves there, equal digits in their order. After the last pass the
position is the rank. A chunk is bounded, and so is the number of different digits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.tables import written

BUCKETS, NGRAM, SEED = 10_000, 1, 2024
MIN_WORDS, PERCENT = 20, 10
#: A digit of the sort has so many bits at most; a chunk so many rows.
DIGIT_BITS, CHUNK_ROWS = 14, 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: CRC-32 of each single byte's state: eight steps by the reversed polynomial.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
#: Longer words are hashed one by one.
_LONG = 48


def span_crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each span of bytes, all spans a byte at a time."""
    lengths = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(lengths, kind="stable")
    short = int(np.searchsorted(lengths[order], _LONG, "right"))
    at, ordered, state = starts[order[:short]], lengths[order[:short]], crc[:short].copy()
    for k in range(int(ordered[-1]) if short else 0):
        first = int(np.searchsorted(ordered, k, "right"))  # spans of more than k bytes
        now = state[first:]
        state[first:] = _CRC[(now ^ data[at[first:] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc[order[:short]] = ~state
    for k in order[short:]:
        crc[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes())
    return crc


def feature_spans(data: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 1 to ``ngram`` words of each text, joined by a space: their bytes, starts and ends, the text of each, and words per text."""
    lower = textkit.lower_ascii(data)
    starts, ends, per = textkit.runs(_WORD[lower], offsets)
    # the words of all texts again, each followed by one space
    lengths = ends - starts
    own = np.zeros(int((lengths + 1).sum()), np.uint8) + np.uint8(32)
    new = np.cumsum(lengths + 1) - (lengths + 1)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own[np.repeat(new, lengths) + within] = lower[np.repeat(starts, lengths) + within]
    text = np.repeat(np.arange(len(per)), per)
    left = np.repeat(np.cumsum(per), per) - np.arange(len(text))  # words from here to the text's end
    found = [(new[left > k], (new + lengths)[np.flatnonzero(left > k) + k], text[left > k]) for k in range(ngram)]
    return own, np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]), per


def _buckets(batch: pa.RecordBatch, buckets: int, ngram: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, the bucket and the row of each feature, and words per row."""
    for rows, data, offsets in textkit.slices(batch, "text"):
        own, starts, ends, text, per = feature_spans(data, offsets, ngram)
        yield rows, span_crc32(own, starts, ends).astype(np.int64) % buckets, text, per


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """Features of all texts in each bucket. One number per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket, _, _ in _buckets(batch, buckets, ngram):
                total += np.bincount(bucket, minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over its share of the source, one added to each count."""
    every_s, every_t, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * float(every_s + buckets) / (float(s + 1) * float(every_t + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64
    )


def _weights(table, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            for rows, bucket, text, per in _buckets(batch, len(gain), ngram):
                n, weight = np.bincount(text, minlength=len(per)), np.zeros(len(per), np.int64)
                np.add.at(weight, text, gain[bucket])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(per), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def weighted(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """Documents (doc_id, text) and target texts (text) to doc_id, n_words, n_features and weight."""
    gain = gains(bucket_counts(docs, buckets, ngram), bucket_counts(target, buckets, ngram))
    table = docs.sparkSession.sparkContext.broadcast(gain)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_weights(table, ngram), "doc_id long, n_words long, n_features long, weight long")


def with_noise(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: weight and the document's own Gumbel noise in thousandths, from a hash of its id. Null without a doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))))


def destinations(digit: np.ndarray, position: np.ndarray, begins: dict[int, int]) -> np.ndarray:
    """New positions of a chunk's rows by counting: where their digit begins, and their place among the equal ones in order of position."""
    order = np.empty(len(position), np.int64)
    order[position - position.min()] = np.arange(len(position))  # positions of a chunk have no gaps
    by_digit = order[np.argsort(digit[order].astype(np.uint16 if digit.max() < 1 << 16 else np.int64), kind="stable")]  # by counting, where numbers have 16 bits
    many = np.bincount(digit)
    values = np.flatnonzero(many)
    many = many[values]
    shift = np.array([begins[v] for v in values.tolist()], np.int64) - (np.cumsum(many) - many)
    out = np.empty(len(position), np.int64)
    out[by_digit] = np.repeat(shift, many) + np.arange(len(position))
    return out


def _moves(names: list[str], smaller):
    """``smaller`` has the rows with a smaller digit, for each digit; ``before`` those with the same digit in chunks before."""

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        digit, before = counts.column("digit").to_numpy(), counts.column("before").to_numpy()
        begins = dict(zip(digit.tolist(), (smaller.value[digit] + before).tolist()))
        to = destinations(rows.column("digit").to_numpy(), rows.column("position").to_numpy(), begins)
        return pa.table([pa.array(to) if c == "position" else rows.column(c) for c in names], names)

    return run


def composite_digits(keys: list[tuple[Column, int]], most_bits: int) -> list[tuple[Column, int]]:
    """Digits of a composite key, from the least significant, each with its bits: the first key's bits are the lowest. A key is given with its number of bits."""
    total = sum(bits for _, bits in keys)
    size = -(-total // max(1, -(-total // most_bits)))
    out = []
    for low in range(0, total, size or 1):
        digit, at = F.lit(0).cast("long"), 0
        for key, bits in keys:
            first, last = max(low, at), min(low + size, at + bits)
            if first < last:
                part = F.shiftright(key, first - at).bitwiseAND(F.lit((1 << (last - first)) - 1))
                digit = digit.bitwiseOR(F.shiftleft(part.cast("long"), first - low))
            at += bits
        out.append((digit, min(size, total - low)))
    return out


def radix_ranked(rows: DataFrame, digit_bits: int = DIGIT_BITS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score), without nulls, with their rank from 1: greatest score first, then least doc_id, then fewest
    features. Rows that are alike in all three are alike in every column; they have different ranks, in any order."""
    spark, columns = rows.sparkSession, ["doc_id", "n_words", "n_features", "weight", "score"]
    rows = rows.select(columns)
    ends = [f(c).alias(f"{a}_{c}") for c in ("score", "doc_id", "n_features") for a, f in (("low", F.min), ("high", F.max))]
    span = rows.agg(F.count("*").alias("n"), *ends).first()
    if not span["n"]:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    size = -(-span["n"] // max(-(-span["n"] // chunk_rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # keys count from 0, so that there are no more digits than differ
    bits = lambda c: (span[f"high_{c}"] - span[f"low_{c}"]).bit_length()
    keys = [(F.col(c) - F.lit(span[f"low_{c}"]), bits(c)) for c in ("n_features", "doc_id")] + [(F.lit(span["high_score"]) - F.col("score"), bits("score"))]
    at = written(rows.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    counts = at.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    shift = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_shift"))  # one row per partition
    names = [*columns, "position"]
    state = written(at.join(F.broadcast(shift), "_range").select(*columns, (F.col("_at") + F.col("_shift")).alias("position")), "positions")
    schema, chunk, by_digit = ", ".join(f"{c} long" for c in names), F.floor(F.col("position") / size).alias("chunk"), Window.partitionBy("digit")
    for digit, width in composite_digits(keys, digit_bits):
        keyed = state.select(*names, digit.alias("digit"), chunk)
        counted = keyed.groupBy("chunk", "digit").agg(F.count("*").alias("n"))
        before = F.sum("n").over(by_digit.orderBy("chunk")) - F.col("n")
        counted = written(counted.select("chunk", "digit", before.alias("before"), F.sum("n").over(by_digit).alias("total")), "digits")
        totals = np.zeros(1 << width, np.int64)
        for row in counted.where("before = 0").select("digit", "total").collect():  # one row per digit
            totals[row["digit"]] = row["total"]
        smaller = spark.sparkContext.broadcast(np.cumsum(totals) - totals)
        moved = keyed.groupBy("chunk").cogroup(counted.select("chunk", "digit", "before").groupBy("chunk")).applyInArrow(_moves(names, smaller), schema)
        state = written(moved, "positions")
    return state.select(*columns, (F.col("position") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """Documents (doc_id, text) and target texts (text) to doc_id, n_features, weight, score and rank, one row per row.

    Of the N rows with a doc_id and at least ``min_words`` words, floor(percent * N / 100) are drawn and have a rank from 1; it is null for all others. A
    null, empty or wordless text has no features and weight 0. A row without doc_id counts in the shares, has a null score and is never drawn. Rows
    of one doc_id are drawn each on its own, with the same noise; ties go to the smaller doc_id, then to fewer features. With an empty target all gains
    come from the documents; empty documents give an empty result. Other columns are ignored."""
    scored = written(with_noise(weighted(docs, target, buckets, ngram), seed), "weights")
    joins = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    n = scored.where(joins).count()
    ranked = radix_ranked(scored.where(joins))
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    return (
        ranked.select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
        .unionByName(scored.where(~joins).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    )
