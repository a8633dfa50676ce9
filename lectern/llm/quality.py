"""Document quality from a conditional random field over the lines of a text.

Every line is labelled good or bad. Its features, and those of the lines before
and after it, give the scores of the two labels; transitions are learned. The
marginals of forward-backward, weighted by line length, are summed up to one
log-odds per document, which a logistic fit on the training documents turns into
the score. Features come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.crf import Adam, Lattice, gradients, marginals
from lectern.llm.tables import sampled

#: The field is fitted on at most so many labelled documents and bytes of text, taken by a hash of their id.
TRAIN_DOCS, TRAIN_BYTES = 4000, 24 << 20
THRESHOLD = 0.3
STEPS = 150

#: Byte classes whose shares are features (fixed values).
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#*$%&<>@^~=+_\\{}[]/",
    "quote": b"\"'()-",
    "wide": bytes(range(128, 256)),
}
_OF = np.zeros((len(CLASSES), 256), bool)
for _k, _chars in enumerate(CLASSES.values()):
    _OF[_k, list(_chars)] = True
N_OWN = len(CLASSES) + 9
N_FEATURES = 3 * N_OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each non-empty line, its bytes, and lines per text."""
    starts, ends, per = textkit.runs(data != 10, offsets)
    n, size = len(starts), (ends - starts).astype(np.float64)
    own = np.zeros((n, N_OWN), np.float32)
    for k, of in enumerate(_OF):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(of[data], out=total[1:])
        own[:, k] = (total[ends] - total[starts]) / size
    low = textkit.lower_ascii(data)
    w_start, w_end, w_per = textkit.words(low, offsets)
    hashes = textkit.span_hashes(low, w_start, w_end)
    a, b = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    count = np.maximum(b - a, 1)
    # words and word triples met before in the same text
    owner = np.repeat(np.arange(len(w_per)), w_per).astype(np.uint64)
    triple, t_per = textkit.shingle_hashes(hashes, w_per, 3)
    t_owner = np.repeat(np.arange(len(t_per)), t_per).astype(np.uint64)
    seen_t = np.zeros(len(hashes), np.float64)
    again = _seen_before(triple, t_owner)
    t_first = np.cumsum(w_per) - w_per
    place = np.arange(len(triple)) - np.repeat(np.cumsum(t_per) - t_per, t_per) + np.repeat(t_first, t_per)
    seen_t[place] = again
    seen_w = _seen_before(hashes, owner)
    line_hash = textkit.span_hashes(data, starts, ends)
    line_owner = np.repeat(np.arange(len(per)), per)
    total = lambda x: np.r_[0, np.cumsum(x)][b] - np.r_[0, np.cumsum(x)][a]
    k = len(CLASSES)
    own[:, k] = total(seen_t) / count
    own[:, k + 1] = total(seen_w) / count
    own[:, k + 2] = _seen_before(line_hash, line_owner.astype(np.uint64))
    own[:, k + 3] = np.log1p(count) / 5
    own[:, k + 4] = np.minimum(size / count / 20, 2)
    own[:, k + 5] = _OF[4][data[ends - 1]] if n else 0
    own[:, k + 6] = own[:, list(CLASSES).index("symbol")] > 0.05
    own[:, k + 7] = own[:, list(CLASSES).index("upper")] > 0.4
    own[:, k + 8] = count < 4
    full = np.zeros((n, N_FEATURES), np.float32)
    full[:, :N_OWN] = own
    same = line_owner[1:] == line_owner[:-1]
    full[1:, N_OWN : 2 * N_OWN][same] = own[:-1][same]
    full[:-1, 2 * N_OWN : 3 * N_OWN][same] = own[1:][same]
    full[:, -1] = 1
    return full, size, per


def _seen_before(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """1 where the same hash stands earlier in the same text."""
    key = textkit.mix64(hashes ^ textkit.mix64(owner, 8), 9)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), np.float64)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


class Model:
    """Weights of the field and of the logistic fit on top."""

    def __init__(self, prior: float):
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.weights, self.trans, self.start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
        self.slope, self.shift = 0.0, float(np.log(prior / (1 - prior)))

    def odds(self, features: np.ndarray, size: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted share of good lines; 0 for a text without lines."""
        emit = ((features - self.mean) / self.scale) @ self.weights
        good = marginals(emit, Lattice(per), self.trans, self.start)[:, 1] if len(emit) else np.zeros(0)
        owner = np.repeat(np.arange(len(per)), per)
        share = np.bincount(owner, good * size, len(per)) / np.maximum(np.bincount(owner, size, len(per)), 1)
        share = np.clip(share, 1e-4, 1 - 1e-4)
        return np.where(per > 0, np.log(share / (1 - share)), 0)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        odds = self.odds(*line_features(data, offsets))
        return 1 / (1 + np.exp(-(self.slope * odds + self.shift)))

    @classmethod
    def fit(cls, texts: list[str | None], quality: np.ndarray) -> Model:
        """Lines take the label of their document. Without both labels the score is the share of label 1."""
        model = cls(float(np.clip(quality.mean(), 0.01, 0.99)) if len(quality) else 0.5)
        if len(set(quality.tolist())) < 2:
            return model
        rows = pa.record_batch([pa.array(texts, pa.string())], ["text"])
        features, size, per = (np.concatenate(x) for x in zip(*(line_features(data, offsets) for _, data, offsets in textkit.slices(rows, "text"))))
        model.mean[:-1], model.scale[:-1] = features[:, :-1].mean(0), np.maximum(features[:, :-1].std(0), 0.02)
        x = (features - model.mean) / model.scale
        labels, lattice, ascent = np.repeat(quality, per), Lattice(per), Adam(0.1)
        for _ in range(STEPS):
            _, node, pair, first = gradients(x @ model.weights, labels, lattice, model.trans, model.start)
            ascent.step(w=(model.weights, x.T @ node / len(x) - 1e-3 * model.weights), t=(model.trans, pair / len(x)), s=(model.start, first / len(per)))
        odds, fitted, ascent = model.odds(features, size, per), np.array([1.0, model.shift]), Adam(0.05)
        for _ in range(400):
            miss = quality - 1 / (1 + np.exp(-(fitted[0] * odds + fitted[1])))
            ascent.step(f=(fitted, np.array([(miss * odds).mean() - 1e-3 * fitted[0], miss.mean()])))
        model.slope, model.shift = float(fitted[0]), float(fitted[1])
        return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, limit_bytes: int = TRAIN_BYTES) -> Model:
    """Fits the field on at most ``limit`` labelled documents outside the held-out fifth. A document with two labels takes the lower one."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = sampled(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality"), "doc_id", "text", limit, limit_bytes)
    return Model.fit(rows["text"].tolist(), rows["quality"].to_numpy(np.int64))


def with_score(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """The documents, all columns, with their score as one more column, which replaces one of that name. The model is fitted on documents with a doc_id; every
    row has a score, also with a null or repeated doc_id."""
    model, docs = train(docs, labels), docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in textkit.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.scores(data, offsets), pa.float64())], [*rows.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents (doc_id, text) to doc_id, held_out, score and predicted (1 if score >= threshold).

    A null, empty or blank-line-only text gets the score of even odds. held_out is false for a null doc_id. Repeated rows are scored
    each. Other columns of both tables are ignored."""
    scored = with_score(docs.select(F.col("doc_id").cast("long"), "text"), labels, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
