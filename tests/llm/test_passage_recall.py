"""Passages with words replaced, put in and left out, and passages whose centres are held by other texts too."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import passages, textkit


def prose(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def tokens_of(words):
    return passages.tokens(*textkit.raw(textkit.texts_of(pa.array([" ".join(words)], pa.string()))))[0]


def jaccard(a, b):
    common = len(np.intersect1d(a, b))
    return common / (len(np.unique(a)) + len(np.unique(b)) - common)


def brute_force(own, source):
    """Whether any spans of MIN_TOKENS or more tokens, up to 20 apart in length, are alike."""
    n = passages.MIN_TOKENS
    for a in range(len(own) - n + 1):
        for b in range(len(own), a + n - 1, -1):
            for c in range(max(0, a - 9), min(len(source) - n, a + 9) + 1):
                for d in range(min(len(source), b + 9), max(c + n, b - 9) - 1, -1):
                    if jaccard(own[a:b], source[c:d]) >= passages.SIMILARITY:
                        return True
    return False


def edited(rng, words, kinds):
    words = list(words)
    for kind in kinds:
        k = rng.randrange(5, len(words) - 5)
        words[k : k + (kind != "in")] = [] if kind == "out" else [f"x{rng.randrange(9999)}"]
    return words


def found(own, source):
    low = np.flatnonzero(np.isin(own, source))
    matches = [{"hash": 0, "at": int(i), "source_at": int(np.flatnonzero(source == own[i])[0])} for i in low[:: max(1, len(low) // 5)]]
    return passages.confirmed(1, 0, own, passages.Source(source), matches)


@pytest.mark.parametrize("kinds", [("swap",), ("in",), ("out",), ("swap", "in"), ("in", "out"), ("swap", "swap", "out")])
def test_edited_passages(kinds):
    rng = random.Random(str(kinds))
    alike = 0
    for _ in range(12):
        words = prose(rng, rng.randrange(60, 110))
        other = edited(rng, words, kinds)
        a, b = tokens_of(words), tokens_of(other)
        around = lambda x: prose(rng, 40) + x + prose(rng, 40)
        got = found(tokens_of(around(other)), tokens_of(around(words)))
        if jaccard(a, b) >= 0.8:
            alike += 1
            assert got and max(x[2] for x in got) >= len(other) - 1
        elif brute_force(b, a):
            assert got
        for _, start, n, _, source_start, similarity, source_n in got:
            assert n >= 50 and source_n >= 50 and similarity >= 0.8
    assert alike or len(kinds) == 3


def test_one_word_in_the_middle(spark):
    rng = random.Random(1)
    words = prose(rng, 80)
    put_in, left_out, swapped = list(words), list(words), list(words)
    put_in.insert(40, "x1")
    del left_out[40]
    swapped[40] = "x2"
    rows = [(i, " ".join(prose(rng, 60) + x + prose(rng, 60))) for i, x in enumerate((words, put_in, left_out, swapped))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["n_words"], r["source_start"], r["source_n_words"]) for r in got if r["source_doc_id"] == 0} == {(1, 60, 81, 60, 80), (2, 60, 79, 60, 80), (3, 60, 80, 60, 80)}


def test_first_places_in_other_texts(spark):
    """Every centre of the passage stands first in a text that holds only a few words around it, so that the stars never join the two that share the passage."""
    rng = random.Random(6)
    shared = prose(rng, 70)
    rows = [(i, " ".join(prose(rng, 60) + shared[a : a + 20] + prose(rng, 60))) for i, a in enumerate(range(0, 51, 5))]
    rows += [(100 + i, " ".join(prose(rng, 60) + shared + prose(rng, 60))) for i in range(3)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["start"], r["n_words"], r["source_doc_id"]) for r in got} >= {(101, 60, 70, 100), (102, 60, 70, 100)}
    assert all(r["source_doc_id"] >= 100 for r in got)


@pytest.mark.parametrize("n_edits", [0, 1])
def test_recall_of_edited_passages(spark, n_edits):
    """Passages of 60 to 120 words shared by two texts, with a word replaced, put in or left out anywhere: nine in ten are found at the least, all if they are equal."""
    rng = random.Random(20 + n_edits)
    rows, pairs = [], []
    for k in range(60):
        words = prose(rng, rng.randrange(60, 121))
        other = edited(rng, words, [("swap", "in", "out")[k % 3]] * n_edits)
        if jaccard(tokens_of(words), tokens_of(other)) < 0.8:
            continue
        around = lambda x: " ".join(prose(rng, rng.randrange(0, 80)) + x + prose(rng, rng.randrange(0, 80)))
        rows += [(2 * k, around(words)), (2 * k + 1, around(other))]
        pairs.append((2 * k + 1, 2 * k, len(other)))
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        key = r["doc_id"], r["source_doc_id"]
        got[key] = max(got.get(key, 0), r["n_words"])
    found = sum(got.get((a, b), 0) >= 50 for a, b, _ in pairs)
    assert len(pairs) > 50 and found >= (0.9 if n_edits else 1) * len(pairs)
    if not n_edits:
        assert all(got[a, b] >= n for a, b, n in pairs)


def test_loops(spark):
    """A text of one word over and over is a repeat as a whole, in its own text and of another; so is a passage that ends in a loop."""
    rng = random.Random(9)
    shared = prose(rng, 60)
    rows = [(0, "one " * 80), (1, "one " * 300), (2, " ".join(prose(rng, 30) + shared + ["end"] * 20)), (3, " ".join(shared + ["end"] * 90 + prose(rng, 30)))]
    got = {(r["doc_id"], r["source_doc_id"]): r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 0]["n_words"] == 300 and got[0, 0]["n_words"] >= 79 and got[3, 2]["n_words"] >= 80
