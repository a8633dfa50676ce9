"""Stored tables follow their sources; only partitions that have changed are written anew."""

import os
import shutil

import pyarrow.parquet as pq
import pytest
from oracle import connection, difference

from lectern.plans import registry
from lectern.plans.views import TABLES, Corpus
from lectern.sources import store

SF = "/root/testdata/sf0.001"
STORED = "chapter_verses verse_lookup book_verses chapter_head lexicon_entry lexicon_range lexicon_by_testament lexicon_range_probe lexicon_gaps lexicon_suffix_probe lexicon_array distinct_chapters".split()


@pytest.fixture
def copy(tmp_path):
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    os.chmod(tmp_path, 0o755)
    return str(tmp_path)


def rewrite(folder, table, change):
    path = f"{folder}/{table}.parquet"
    new = change(pq.read_table(path))
    os.remove(path)
    pq.write_table(new, path)


def wrong(spark, folder):
    con = connection(folder)
    # the other tables of the connection are not in the folder
    return [n for n in STORED if difference(registry.QUERIES[n](spark, folder), con, registry.ORACLE_SQL[n])]


def test_lookups_follow_a_source_that_is_rewritten(spark, copy):
    for t in ("embeddings", "pages", "benchmark", "labels", "conversations"):
        shutil.copy(f"{SF}/{t}.parquet", f"{copy}/{t}.parquet")
    assert wrong(spark, copy) == []
    rewrite(copy, "part", lambda t: t.slice(0, 60))
    assert registry.QUERIES["lexicon_by_testament"](spark, copy).count() == len([k for k in range(60) if k % 13])
    assert wrong(spark, copy) == []
    rewrite(copy, "orders", lambda t: t.slice(5))
    assert wrong(spark, copy) == []


def files_of(table):
    return {(r["p"].split("/data/")[1], r["t"]) for r in table.spark.read.parquet(f"{table.path}/data").selectExpr("_metadata.file_path AS p", "_metadata.file_modification_time AS t").distinct().collect()}


V = "version string, engs string, chap int, sec int, txt string"


def test_only_changed_books_are_written(spark, tmp_path):
    rows = [("kjv", b, c, s, f"{b} {c} {s}") for b in ("Gen", "Exo", "Lev") for c in (1, 2) for s in (1, 2, 3)]
    table = store.verses(spark, str(tmp_path / "t"))
    df = lambda r: spark.createDataFrame(r, V)
    refresh = lambda r, source: table.refresh(lambda: df(r), source)
    assert table.read().collect() == []
    assert len(refresh(rows, "one")) == 3
    first = files_of(table)
    early = table.read()
    assert refresh([], "one") == []  # the same sources: nothing is looked at
    changed = [r if r[1] != "Exo" or r[2] != 2 else (*r[:4], None) for r in rows if r[1] != "Lev"] + [("kjv", "Num", 1, 1, "new")]
    assert [p.count("Exo") + 2 * p.count("Num") for p in refresh(changed, "two")] == [1, 2]
    assert first < files_of(table)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, df(changed).collect()))
    assert early.count() == 18  # who read before still reads what was
    assert refresh(changed[::-1], "three") == []  # other files, the same rows
    assert refresh(rows, "four") and sorted(map(tuple, table.read().collect())) == sorted(rows)
    assert refresh([], "five") == [] and table.read().collect() == []
    assert len(refresh(rows, "six")) == 3 and table.read().count() == 18


def test_partitions_with_nulls_and_odd_names(spark, tmp_path):
    rows = [("kjv", None, 1, 1, "a"), ("kjv", "1 Sam/uel=%", 1, 1, "b"), ("kjv", "", 1, 1, "c")]
    table = store.verses(spark, str(tmp_path / "t"))
    table.refresh(lambda: spark.createDataFrame(rows[:2], V), "one")
    assert sorted(map(str, table.read().collect())) == sorted(map(str, spark.createDataFrame(rows[:2], V).collect()))
    assert len(table.refresh(lambda: spark.createDataFrame(rows[:1] + [("kjv", "1 Sam/uel=%", 1, 1, "x")], V), "two")) == 1
    assert {r["txt"] for r in table.read().collect()} == {"a", "x"}


def test_a_chapter_still_reads_one_folder(spark, copy):
    from lectern.operators import lookup

    c = Corpus(spark, copy)
    c.stored("verses_tagged")
    rewrite(copy, "lineitem", lambda t: t.slice(1))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = lookup.chapter_verses(Corpus(spark, copy).stored("verses_tagged"), "NATION_19", 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(chap,1)" in plan and "NATION_19)" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
