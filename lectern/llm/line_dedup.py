"""Line deduplication by winnowing over line hashes.

A text is the sequence of its lines that hold a word. A window is a run of such
lines that is just long enough to hold ``MIN_WORDS`` words, the shortest from a line
on or up to it; one long line is a window, as are many short ones. The least line
hash of each window (the last one on ties) is a fingerprint, so two texts that
share a run of that many words, in however many lines, are sure to share a
fingerprint at the same place of it. Positions of equal fingerprints are joined, and
only those that occur elsewhere are gone on with. There the match is extended both ways,
window by window: the windows around the position that are equal in both places
overlap and make up the whole run. Of equal windows the first one, by doc_id and
line, stays; the lines of the later ones are deleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.tables import sized, written

#: Words that equal lines in a row must hold together to count as a repeat.
MIN_WORDS = 10

#: A column that documents do not have.
_DROPS = "_drops_of_lines"
_PRINTS = "doc_id long, text_key long, print long, leads boolean, run_a long, run_b long, start int, size int"
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _worded_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: starts, ends, words, and such lines per text."""
    starts, ends, _ = textkit.runs(data != 10, offsets)
    word_starts, _, _ = textkit.words(data, offsets)
    n_words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    starts, ends, n_words = starts[n_words > 0], ends[n_words > 0], n_words[n_words > 0]
    owner = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, n_words, np.bincount(owner, minlength=len(offsets) - 1)


def word_windows(n_words: np.ndarray, per: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the shortest windows of ``min_words`` words or more from each line on and up to each line, inside its text."""
    total, n = np.r_[0, np.cumsum(n_words)], np.arange(len(n_words))
    last = np.repeat(np.cumsum(per), per)
    end = np.searchsorted(total, total[:-1] + min_words)
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    on, up = end <= last, start >= last - np.repeat(per, per)
    both = np.unique(np.stack([np.r_[n[on], start[up]], np.r_[end[on], n[up] + 1]]), axis=1)
    return both[0], both[1]


def fingerprints(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The place of each window's least hash; of equal ones the last."""
    place = start.copy()
    for k in range(1, int((end - start).max(initial=0))):
        at = np.flatnonzero(end - start > k)
        lower = hashes[start[at] + k] <= hashes[place[at]]
        place[at[lower]] = start[at[lower]] + k
    return place


def _prints(min_words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = textkit.mix64(np.arange(2 * min_words, dtype=np.uint64), 3).reshape(2, -1) | np.uint64(1)
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, "text"):
                starts, ends, n_words, per = _worded_lines(data, offsets)
                hashes = [textkit.span_hashes(data, starts, ends, k) for k in (0, 1)]
                start, end = word_windows(n_words, per, min_words)
                size, run = end - start, [np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)]
                for k in range(int(size.max(initial=0))):
                    longer = size > k
                    for of_run, h, factor in zip(run, hashes, factors):
                        of_run[longer] += h[start[longer] + k] * factor[k]
                run = [textkit.mix64(x + size.astype(np.uint64), 4 + k).view(np.int64) for k, x in enumerate(run)]
                place = fingerprints(hashes[0], start, end)
                leads = np.zeros(len(place), bool)
                leads[np.unique(place, return_index=True)[1]] = True
                owner = np.repeat(np.arange(len(per)), per)[start]
                first = (np.cumsum(per) - per)[owner]
                columns = [rows.column(c).take(pa.array(owner)) for c in ("doc_id", "text_key")] + [
                    pa.array(x) for x in (hashes[0][place].view(np.int64), leads, *run, (start - first).astype(np.int32), size.astype(np.int32))
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PRINTS.split(", ")])

    return of


def _without_lines(counts: tuple[str, str]):
    """Drops are (start, size) among the lines with a word."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column("text").to_pylist(), batch.column(_DROPS).to_pylist()
            n_lines = [0 if text is None else text.count("\n") + 1 for text in texts]
            n_removed = [0] * len(texts)
            for i, (text, drop) in enumerate(zip(texts, drops)):
                if drop:
                    lines = text.split("\n")
                    worded = [k for k, x in enumerate(lines) if _HAS_WORD.search(x)]
                    gone = {k for d in drop for k in worded[d["start"] : d["start"] + d["size"]]}
                    texts[i], n_removed[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
            names = [c for c in batch.schema.names if c != _DROPS]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, *counts])

    return of


def _later_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, drops): the windows to delete, of the texts that have some."""
    keyed = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    prints = written(keyed.mapInArrow(_prints(min_words), _PRINTS), "prints")
    shared = prints.groupBy("print").agg(F.count_if("leads").alias("n")).where("n > 1").select("print")
    around = written(prints.join(sized(shared), "print").drop("print", "leads"), "around")
    first = around.groupBy("run_a", "run_b").agg(F.min(F.struct("doc_id", "text_key", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = around.join(sized(first), ["run_a", "run_b"]).where("struct(doc_id, text_key, start) > first")
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("drops"))


def edited_documents(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The documents, all columns, with later repeated runs of lines taken out of text, and two more columns, the ``counts`` of lines and of lines removed.

    Lines end at \\n and are compared by two 64-bit hashes of their bytes; lines without a word are not compared and stay. A null text stays null with no
    lines, an empty one has one line. Texts of fewer than ``min_words`` words and rows without doc_id are returned as they are. Rows of one doc_id and
    one text are one document; of rows of one doc_id with different texts that share a run, the one whose text has the smaller hash keeps it. Columns named as the counts are replaced; all others are passed on."""
    docs = docs.drop(*counts)
    drops = _later_runs(docs, min_words).select(F.col("doc_id").alias("_drops_doc"), F.col("text_key").alias("_drops_key"), F.col("drops").alias(_DROPS))
    joined = docs.join(drops, (F.col("doc_id") == F.col("_drops_doc")) & (F.xxhash64("text") == F.col("_drops_key")), "left").drop("_drops_doc", "_drops_key")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{counts[0]}` long, `{counts[1]}` long"
    return joined.mapInArrow(_without_lines(counts), schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``edited_documents`` with only doc_id, text, n_lines and n_removed."""
    return edited_documents(docs.select("doc_id", "text"), min_words)
