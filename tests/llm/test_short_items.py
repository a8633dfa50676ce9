"""Benchmark items of one to four words, as a class of their own."""

import re

import pytest
from oracle import connection, difference

from lectern.llm import decontam
from lectern.llm.oracle import ORACLE_SQL

DOCS = [(1, "The Red, red fox. Jumps!"), (2, "a redder fox"), (3, "fox"), (3, "red\nfox"), (None, "red fox"), (4, None), (5, ""), (6, "été à la mer, " * 9), (7, "one two three four five six")]
ITEMS = [(1, "red fox"), (2, "RED fox jumps"), (3, "fox!"), (4, "à la mer"), (5, "two three four five"), (6, ""), (7, None), (None, "fox"), (8, "the red red fox jumps"), (9, "x y"), (3, "mer")]


def words(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).split()


@pytest.mark.parametrize("limit", [200_000, -1])
def test_short_items_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame([(*r, "x", 1) for r in DOCS], "doc_id long, text string, run string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = set()
    for d, t in DOCS:
        for i, x in ITEMS:
            w, own = words(t), words(x)
            if d is not None and i is not None and 1 <= len(own) <= 4 and any(w[k : k + len(own)] == own for k in range(len(w))):
                want.add((d, i, len(own)))
    got = [tuple(r) for r in decontam.short_matches(docs, items).collect()]
    assert sorted(got) == sorted(want) and len(want) > 8
    assert {r["doc_id"] for r in decontam.decontaminated(docs, items, short_items=True).collect()} == {None, 2, 4, 5} - {d for d, _, _ in want}
    assert {r["doc_id"] for r in decontam.decontaminated(docs, items).collect()} == {None, 2, 3, 4, 5, 6, 7}


def test_the_query_and_its_sql_with_short_items(spark, tmp_path):
    for name, rows, schema in (("documents", DOCS, "doc_id long, text string"), ("benchmark", ITEMS, "item_id long, text string")):
        spark.createDataFrame([r for r in rows if r[0] is not None], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    read = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    assert difference(decontam.all_matches(read("documents"), read("benchmark")), con, ORACLE_SQL["op10_benchmark_decontamination"]) is None


def test_without_short_items_the_documents_are_not_read(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e"), (2, None)], "item_id long, text string")
    assert "text" not in decontam.short_matches(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert decontam.short_matches(docs, items).collect() == []


def test_sf(spark):
    sf = "/root/testdata/sf0.001"
    from lectern.llm.queries import QUERIES

    assert difference(QUERIES["op10_benchmark_decontamination"](spark, sf), connection(sf), ORACLE_SQL["op10_benchmark_decontamination"]) is None
