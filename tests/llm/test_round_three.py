"""BPE, centroids and resampling against brute force, and on nulls, repeats, ties, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import bpe, centroids, resampling
from lectern.llm.queries import tokenizer_file

BPE = tokenizer_file("byte_bpe_50k.json")


def odd_texts(n):
    rng = random.Random(3)
    signs = [*"abcXYZ  \n\t'.,!?123éßñ中文한́‍😀\x85\xa0  \U0001e5f0\x1c\r", "'s", "'re", "<|endoftext|>", "  ", "don't", "Ᲊ", "½", "٣", "<|endof"]
    made = ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(n)]
    return ["", None, "<|endoftext|>", "a  <|endoftext|>  b<|endoftext|>", "word " * 3000, "x" * 30_000 + " y", *made, *made[:50]]


@pytest.mark.parametrize(("words", "texts_sent"), [(1_000_000, 1000), (40, 1000), (40, 0), (0, 0)])
def test_ids_and_texts_are_those_of_the_tokenizer(spark, words, texts_sent):
    """With a table of all words, of the most frequent ones, and of none, so that all are joined, by broadcasts and by shuffles."""
    texts = odd_texts(1500)
    rows = [(None if k % 9 == 4 else k // 2, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    got = bpe.decode(bpe.encode(docs, BPE, table_words=words, fill_texts=texts_sent), BPE).collect()
    assert sorted(map(str, bpe.round_trip(docs, BPE, table_words=words, fill_texts=texts_sent).collect())) == sorted(map(str, got))
    tokenizer = bpe.tokenizer_of(BPE)
    want = Counter()
    for k, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(k, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == want


def test_decoding_of_any_ids(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(50257) for _ in range(rng.randint(0, 6))],) for _ in range(3000)]
    tokenizer = bpe.tokenizer_of(BPE)
    for r in bpe.decode(spark.createDataFrame(rows, "ids array<int>"), BPE).collect():
        assert r["text"] == tokenizer.decode(r["ids"], skip_special_tokens=False)
    odd = spark.createDataFrame([(None, "a"), ([15339, None, -1, 99_999_999], "b")], "ids array<int>, text string")
    assert [r["text"] for r in bpe.decode(odd, BPE).collect()] == ["", tokenizer.decode([15339])]


def test_split_words_are_the_tokenizers_own(spark):
    from pyspark.sql import functions as F

    tokenizer = bpe.tokenizer_of(BPE)
    texts = [t for t in odd_texts(1200) if t and "<|endoftext|>" not in t]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").where(~bpe.is_odd(F.col("text"))).select("text", bpe.split_words(F.col("text"), []).alias("words")).collect()
    assert len(rows) > 300
    for r in rows:
        assert r["words"] == [r["text"][a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(r["text"])]


def test_encoding_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, BPE).collect() == []
    nulls = bpe.digests(spark.createDataFrame([(None, None)], "doc_id long, text string"), BPE).collect()
    assert [tuple(r) for r in nulls] == [(None, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())]


def lloyd(vectors, k, rounds):
    """All distances anew in every round, in whole numbers of any size."""
    whole = [[math.floor(64 * x) for x in v] for _, v in vectors]
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"1:{vectors[i][0]}".encode()).hexdigest(), whole[i]))
    c = [whole[i] for i in order[:k]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, x)) for x in c] for v in whole]
        return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        at, _ = assign()
        for j in range(len(c)):
            own = [v for v, a in zip(whole, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    at, d = assign()
    own = [sum(d[i][j] for i in range(len(whole)) if at[i] == j) for j in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return Counter((vectors[i][0], at[i], d[i][at[i]], own[at[i]], sum(own), digest[at[i]]) for i in range(len(whole)))


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), (rng.normal(i % 5, 1, 64) * rng.choice([0.01, 1, 30])).astype(np.float32).tolist()) for i in range(180)]
    rows += [(7, rows[7][1]), (7, rows[3][1]), (None, rows[9][1])] + [(1000 + i, rows[0][1]) for i in range(40)]
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [float("nan")] + [1.0] * 63), (8, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows + bad], "vec_id long, embedding array<float>, v string").repartition(5)
    assert Counter(map(tuple, centroids.clustered(df).collect())) == lloyd(rows, 16, 3)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert Counter(map(tuple, centroids.clustered(few).collect())) == lloyd(rows[:5], 5, 3)


def test_clusters_of_no_vectors_and_of_vectors_too_large(spark):
    assert centroids.clustered(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).collect() == []
    for x in (1e9, 1e200):
        with pytest.raises(ValueError):
            centroids.clustered(spark.createDataFrame([(1, [x] * 64)], "vec_id long, embedding array<double>"))


def test_dot_products_follow_the_changed_components_only(spark):
    import pyarrow as pa

    rng = np.random.default_rng(8)
    v, old = rng.integers(-50, 50, (200, 8)), rng.integers(-50, 50, (4, 8))
    change = np.zeros((4, 8), np.int64)
    change[1, 3], change[2, [0, 7]] = 5, (-2, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), centroids._lists(v), pa.array((v * v).sum(1)), centroids._lists(v @ old.T)], ["vec_id", "v", "norm", "dots"])
    (out,) = centroids._updated(change)(iter([batch]))
    assert (centroids._matrix(out.column("dots")) == v @ (old + change).T).all()


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def resampled_plainly(docs, target, ngram=1, percent=10, least=20):
    def words(t):
        return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    def buckets(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, x in docs:
        weight, score = sum(map(gain, buckets(x))), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(buckets(x)), weight, score, None, len(words(x))])
    able = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("ngram", [1, 2])
def test_resampling_against_a_plain_sort(spark, ngram):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "été", "x9", "中文", "don't", "A" * 90] + [f"w{k}" for k in range(60)]
    docs = [(k, rng.choice([" ", "\n", "-", "\x7f"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for k in range(400)]
    docs += [(None, docs[3][1]), (5, docs[5][1]), (5, docs[6][1]), (-8, docs[7][1]), (900, None), (901, ""), (902, "!!"), (903, "long " * 4000)]
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(20)] + [None]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, rank int").repartition(5)
    got = resampling.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), ngram=ngram)
    assert Counter(map(tuple, got.collect())) == resampled_plainly(docs, target, ngram)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert resampling.resampled(none, some).collect() == []
    assert Counter(map(tuple, resampling.resampled(some, none).collect())) == resampled_plainly([(1, "a b " * 20), (2, None)], [])


def test_radix_order_with_ties_and_few_rows_in_a_chunk(spark):
    rng = random.Random(10)
    rows = [(rng.randint(-3, 3) * 10**rng.choice([0, 6, 15]), 30, rng.randint(1, 3), 0, rng.randint(-5, 5) * 10 ** rng.choice([0, 7])) for _ in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long").repartition(3)
    got = sorted(resampling.radix_ranked(df, digit_bits=5, chunk_rows=50).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 701))
    assert [(-r["score"], r["doc_id"], r["n_features"]) for r in got] == sorted((-r[4], r[0], r[2]) for r in rows)


def test_crc32_of_spans():
    rng = random.Random(11)
    parts = [rng.randbytes(rng.choice([0, 1, 3, 8, 47, 48, 49, 300])) for _ in range(500)]
    ends = np.cumsum([len(x) for x in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    assert resampling.span_crc32(data, ends - [len(x) for x in parts], ends).tolist() == [zlib.crc32(x) for x in parts]
