"""Language of code-switched text from a conditional random field over its words.

A word's scores are sums of learned weights of its byte n-grams (two to four,
word edges included, so that they also stand for affixes) and of the whole word,
the lexicon feature. Transitions are learned from sequences that change language.
Forward-backward gives each word's marginals; weighted by word length they give
the text's language. Weights live in hashed tables, and the scores of all words of
a slice are differences of one cumulative sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.crf import Adam, Lattice, gradients, marginals
from lectern.llm.tables import BROADCAST_ROWS, sampled, written

#: The field is fitted on at most so many documents of each language, and bytes of text of all of them together. Every language is learned: the more there
#: are, the fewer documents each has, but at least 10.
TRAIN_DOCS_PER_LANG, TRAIN_DOCS, TRAIN_BYTES = 150, 9600, 32 << 20
#: Words of one training sequence are drawn from runs of at most so many words of one language.
RUN_WORDS = 24
STEPS = 40
#: Weights have tables of 2**BITS rows, or fewer so that all have at most 2**WEIGHT_BITS numbers.
BITS, WEIGHT_BITS = 16, 24
NONE = "und"

_WORD_SIGN = re.compile(r"[^\W\d_]")  # letters, and signs such as a circled or a Roman number
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L stands in a text."""
    return any(m[0].isalpha() for m in _WORD_SIGN.finditer(text))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Words:
    """Hashed features of the words of one slice: letters, ASCII lower-cased, all other bytes as a blank edge. Features are the numbers below 2**BITS."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter = _LETTER[data]
        # Latin-1 signs such as no-break space and guillemets, but for its three letters
        lead = np.flatnonzero(data == 0xC2)
        lead = lead[lead + 1 < len(data)]
        lead = lead[~np.isin(data[lead + 1], [0xAA, 0xB5, 0xBA])]
        letter[lead] = letter[lead + 1] = False
        self.starts, self.ends, self.per = textkit.runs(letter, offsets)
        low = textkit.lower_ascii(data)
        edge = np.full(len(data) + 5, 32, np.uint32)
        edge[1 : len(data) + 1] = np.where(letter, low, 32)
        cut = np.zeros(len(edge), bool)  # an n-gram may end with a blank, not hold one
        blank = edge == 32
        n = len(data) + 2
        b = [edge[k : k + n] for k in range(4)]
        mask = np.uint32((1 << BITS) - 1)
        hashed = lambda *x: (sum(v * np.uint32(m) for v, m in zip(x, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))) >> np.uint32(12)) & mask
        grams = [hashed(b[0], b[1]), hashed(b[0], b[1], b[2]), hashed(*b)]
        cut[:n] = blank[1 : n + 1]
        grams[1] = np.where(cut[:n], 0, grams[1])
        grams[2] = np.where(cut[:n] | blank[2 : n + 2], 0, grams[2])
        self.grams = grams
        self.lexicon = (textkit.span_hashes(low, self.starts, self.ends) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def scores(self, tables: np.ndarray) -> np.ndarray:
        """tables: four of them, with a column per language."""
        rows = tables.shape[1] - 1
        at = tables[0][self.grams[0] & rows] + tables[1][self.grams[1] & rows] + tables[2][self.grams[2] & rows]
        total = np.zeros((len(at) + 1, at.shape[1]), np.float64)
        np.cumsum(at, axis=0, out=total[1:])
        # the blank before a word stands at its start, as the text is moved by one
        return (total[self.ends + 1] - total[self.starts] + tables[3][self.lexicon & rows]).astype(np.float32)


class Model:
    def __init__(self, langs: list[str]):
        n = len(langs)
        rows = 1 << max(4, min(BITS, WEIGHT_BITS - 2 - max(n - 1, 0).bit_length()))
        self.langs, self.tables = langs, np.zeros((4, rows, n), np.float32)
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> Model:
        """Learns from texts of one language each; runs of them are shuffled into sequences that change language."""
        model = cls(sorted(set(langs)))
        n = len(model.langs)
        if n < 2:
            return model
        label = np.array([model.langs.index(x) for x in langs])
        words = Words(*textkit.raw(textkit.texts_of(pa.array(texts, pa.string()))))
        rng = np.random.default_rng(7)
        owner = np.repeat(np.arange(len(texts)), words.per)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(words.per) - words.per, words.per)
        run = np.cumsum(np.r_[True, owner[1:] != owner[:-1]] | (place % RUN_WORDS == 0)) - 1
        shuffled = rng.permutation(run[-1] + 1)
        order = np.argsort(shuffled[run], kind="stable")
        gold = label[owner[order]]
        lengths = np.bincount(shuffled[run[order]] // 4)  # four runs a sequence
        lattice = Lattice(lengths)
        # words by kind: each distinct word's n-grams are looked up once a step
        kinds, first, kind = np.unique(_word_keys(words), return_index=True, return_inverse=True)
        kind = kind[order]
        size = words.ends[first] - words.starts[first] + 1
        rows = np.repeat(np.arange(len(kinds)), size)
        at = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words.starts[first], size)
        width = model.tables.shape[1]
        feats = [g[at].astype(np.int64) & (width - 1) for g in words.grams]
        lexicon = words.lexicon[first] & (width - 1)
        known = np.zeros((4, width, n), np.float32)
        tables, ascent = model.tables, Adam(0.05)
        sums = lambda v: np.add.reduceat(v, np.cumsum(size) - size, axis=0)
        for _ in range(STEPS):
            score = sums(tables[0][feats[0]] + tables[1][feats[1]] + tables[2][feats[2]]) + tables[3][lexicon]
            _, node, pair, begin = gradients(score[kind], gold, lattice, model.trans, model.start)
            slope = np.stack([np.bincount(kind, node[:, k], len(kinds)) for k in range(n)], 1)
            for t, at_feat, of in ((0, feats[0], rows), (1, feats[1], rows), (2, feats[2], rows), (3, lexicon, np.arange(len(kinds)))):
                for k in range(n):
                    known[t, :, k] = np.bincount(at_feat, slope[of, k], width)
            known[1:3, 0] = 0  # cut n-grams weigh nothing
            ascent.step(w=(tables, known / len(order) - 1e-6 * tables), t=(model.trans, pair / len(order)), s=(model.start, begin / len(lengths)))
        return model

    def predict(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a batch, a slice of texts at a time, which bounds the numbers held for words times languages."""
        langs, scores = [], [np.zeros(0)]
        for rows, data, offsets in textkit.slices(batch, "text"):
            found, score = self._predict(rows.column("text"), data, offsets)
            langs += found
            scores.append(score)
        return langs, np.concatenate(scores)

    def _predict(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        words = Words(data, offsets)
        per, weight = words.per, words.ends - words.starts
        n = len(self.langs)
        share = np.zeros((len(per), max(n, 1)))
        if n:
            node = marginals(words.scores(self.tables), Lattice(per), self.trans.astype(np.float32), self.start.astype(np.float32))
            owner = np.repeat(np.arange(len(per)), per)
            for k in range(n):
                share[:, k] = np.bincount(owner, node[:, k] * weight, len(per))
            share /= np.maximum(np.bincount(owner, weight, len(per)), 1)[:, None]
        best = share.argmax(1)
        score = np.clip(share[np.arange(len(per)), best], 0, 1)
        lettered = [p > 0 and n > 0 and has_letter(texts[i].as_py()) for i, p in enumerate(per.tolist())]
        return [self.langs[b] if ok else NONE for b, ok in zip(best.tolist(), lettered)], np.where(lettered, score, 0.0)


def _word_keys(words: Words) -> np.ndarray:
    """A key of each word: equal words, edges included, have equal n-grams."""
    total = np.zeros(len(words.grams[2]) + 1, np.uint64)
    mixed = textkit.mix64(words.grams[2].astype(np.uint64) | (words.grams[0].astype(np.uint64) << np.uint64(20)))
    np.cumsum(mixed, out=total[1:])
    return textkit.mix64(total[words.ends + 1] - total[words.starts]) ^ textkit.mix64(words.lexicon.astype(np.uint64), 6)


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG) -> Model:
    """Fits the field on at most ``per_lang`` documents of each language outside the held-out third, taken by a hash of their id."""
    known = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = written(known.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    n_langs = max(counts.count(), 1)
    per_lang = min(per_lang, max(10, TRAIN_DOCS // n_langs))
    draw, sides = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)), F.broadcast(counts) if n_langs <= BROADCAST_ROWS else counts
    # about twice as many as wanted, so that the exact choice sorts few rows
    few = known.join(sides, "lang").where(draw * F.col("n") < 2_000_000 * per_lang).drop("n")
    rows = sampled(few, "doc_id", "text", per_lang, TRAIN_BYTES // n_langs, "lang")
    return Model.fit(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang) to doc_id, held_out, lang_pred and score, the weighted share of words in that language.

    A text that is null or has no letter gets ``und`` and 0, as does every text if no row has a lang to learn from. held_out is false for a
    null doc_id. Every language that a training row has is learned, on at least 10 documents where it has them; a language of held-out rows alone is not known.
    Repeated rows are predicted each; other columns are ignored."""
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = model.predict(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
