"""Beyond the size for broadcasts, joins shuffle: the same rows, with a third of all texts copies and one line in most of them."""

import collections
import random

import pytest

from lectern.llm import decontam, line_dedup, near_dedup, packing, passages
from lectern.llm.queries import packed_documents
from lectern.llm.tables import written


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    common, shared = prose(12), prose(70)
    rows = [(i, f"{prose(30)}\n{common}\n{prose(30)}") for i in range(80)] + [(i, f"{common}\n{common} end of it\n{prose(3)}") for i in range(80, 120)]
    rows += [(200 + i, f"{prose(20)}\n{shared}\n{common}") for i in range(12)] + [(300 + i, f"{shared} {prose(2)}") for i in range(9)] + [(400, None), (401, ""), (None, common)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df):
    return collections.Counter(map(repr, df.collect()))


def results(docs, bench):
    packed = packed_documents(docs).collect()
    return [
        rows_of(line_dedup.dedup_lines(docs)),
        rows_of(near_dedup.near_duplicates(docs)),
        rows_of(near_dedup.one_of_each(docs)),
        rows_of(passages.repeated_passages(docs)),
        rows_of(decontam.contaminated(docs, bench)),
        rows_of(decontam.decontaminated(docs, bench)),
        (len(packed), len({r["sequence_id"] for r in packed})),
    ]


def test_the_same_rows(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, docs.where("doc_id = 300").first()["text"]), (2, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    with_broadcasts = results(docs, bench)
    for module in (line_dedup, near_dedup, passages, decontam, packing):
        monkeypatch.setattr(module, "sized", lambda df, *_: written(df, "side"))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(passages, "FOLLOWERS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert results(docs, bench) == with_broadcasts
        assert len(with_broadcasts[3]) and len(with_broadcasts[4]) == 21
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
