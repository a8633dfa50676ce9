"""The pipeline's stages on nulls, empty texts, repeated rows, rows without an id, clashing columns, and empty tables."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import quality

SF = "/root/testdata/sf0.001"
EXTRA = "n_lines long, n_removed long, before string, part string, rank int, score double, predicted int, component_id long, kept boolean, length long, ids binary, key string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
VALUES = (7, 8, "b", "p", 1, 0.5, 1, 9, False, 3, b"x", "k")


def prose(rng, n):
    return " ".join(rng.choices("the of river house and morning which under water old letter said never".split(), k=n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["\n".join(prose(rng, 14) for _ in range(4)) for _ in range(6)]
    out = list(enumerate(texts)) + [(20, None), (21, ""), (22, " \n\t\n"), (None, texts[0]), (None, None), (0, texts[0]), (0, texts[0]), (23, texts[1]), (24, f"{texts[2]} more"), (25, texts[3].split("\n")[0])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, *VALUES) for i, t in rows], SCHEMA)


def of(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_columns_and_empty_table(spark, rows, name, stage):
    docs = frame(spark, rows)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert {tuple(r)[5:] for r in out.collect()} <= {VALUES}
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_quality_judges_each_row(spark):
    """Rows without an id and repeated rows too; the model learns from the given table, whose ids the labels have."""
    given, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    by_score = given.join(quality.score_quality(given, labels), "doc_id").where("text <> ''").orderBy("score").select("doc_id", "text").collect()
    worst, best = by_score[0], by_score[-1]
    docs = frame(spark, [*((r["doc_id"], r["text"]) for r in given.collect()), (None, worst["text"]), (None, best["text"]), (-5, None), (-6, ""), tuple(worst), tuple(best)])
    out = of(corpus_pipeline.keep_good(spark, docs, SF))
    assert out.total() == quality.score_quality(docs, labels).where("predicted = 1").count()
    assert out[None, best["text"]] == 1 and out[tuple(best)] == 2 and not out[None, worst["text"]] and not out[tuple(worst)]


def test_lines_of_repeated_rows(spark, rows):
    out = of(corpus_pipeline.drop_repeated_lines(spark, frame(spark, rows), SF))
    assert out[0, rows[0][1]] == 3 and out[None, rows[0][1]] == 1 and out[20, None] == out[21, ""] == out[22, " \n\t\n"] == 1
    assert not any(i in (23, 25) for i, _ in out)  # nothing but lines that stand before
    assert [t for i, t in out if i == 24] == [rows[2][1].split("\n")[-1] + " more"]


def test_one_row_of_each_document(spark, rows):
    out = of(corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), SF))
    assert out[0, rows[0][1]] == 1 and out[None, rows[0][1]] == 1 and out[None, None] == out[20, None] == out[21, ""] == 1
    assert not any(i in (23, 24) for i, _ in out) and (25, rows[-1][1]) in out
    twice = of(corpus_pipeline.keep_one_of_each(spark, frame(spark, [(1, "b c"), (1, "a b"), (1, None)]), SF))
    assert twice == {(1, None): 1}


def test_leaks(spark, rows):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").first()["text"]
    out = of(corpus_pipeline.drop_leaks(spark, frame(spark, [*rows, (50, f"x {item} y"), (50, "other text"), (None, item)]), SF))
    assert out == collections.Counter(rows) + collections.Counter([(None, item)])


def test_packing_of_odd_rows(spark, rows):
    """The sequences hold the ids of every row's text, in the places that they name."""
    from tokenizers import Tokenizer

    from lectern.llm.queries import word_tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = collections.Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    got = collections.Counter()
    for r in corpus_pipeline.pack(spark, frame(spark, rows), SF).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["n_tokens"] == len(ids) <= 2048 and r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
        for p in r["pieces"]:
            got[p["doc_id"], tuple(ids[p["offset"] : p["offset"] + p["length"]])] += 1
    assert got == want
    assert corpus_pipeline.pack(spark, frame(spark, rows).limit(0), SF).collect() == []
