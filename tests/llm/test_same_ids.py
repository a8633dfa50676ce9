"""Rows of one doc_id with different texts in line dedup, and language id in slices."""

import pyarrow as pa

from lectern.llm import langid, line_dedup, textkit


def test_a_line_shared_by_texts_of_one_doc_id(spark):
    line = "a line of rather more than ten words that two texts of one document share"
    docs = spark.createDataFrame([(1, f"{line}\nfirst"), (1, f"{line}\nsecond"), (2, f"{line}\nthird"), (1, f"{line}\nfirst")], "doc_id long, text string")
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()]
    ones = {(t, n) for d, t, n in got if d == 1}
    assert ones in ({(f"{line}\nfirst", 0), ("second", 1)}, {("first", 1), (f"{line}\nsecond", 0)})  # one text of the two keeps it, in all its rows
    assert [(t, n) for d, t, n in got if d == 2] == [("third", 1)]


def test_slices_of_a_batch_give_what_texts_alone_give(monkeypatch):
    texts = ["the house and the river", "la casa y el río", None, "", "der Fluss und das Haus", "12 34"] * 20
    model = langid.Model.fit([t for t in texts if t and t[0].isalpha()], [{"t": "en", "l": "es", "d": "de"}[t[0]] for t in texts if t and t[0].isalpha()])
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    langs, scores = model.predict(batch)
    sizes = []
    whole = textkit.slices
    monkeypatch.setattr(textkit, "slices", lambda b, c: (sizes.append(r[0].num_rows) or r for r in whole(b, c, 60)))
    again, more = model.predict(batch)
    assert again == langs and abs(scores - more).max() < 1e-3 and max(sizes) <= 6
    assert langs[:6] == ["en", "es", "und", "und", "de", "und"]
    assert model.predict(batch.slice(0, 0))[0] == []
