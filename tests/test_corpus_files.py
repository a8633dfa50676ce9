"""Snapshots compared by digests, the corpus as one document in files, and keyword search by pairs."""

import glob
import json

from lectern.operators import parallel, search
from lectern.operators.lookup import keyword_verses
from lectern.sources import corpus_document, snapshots, store

V = "engs string, chap int, sec int, txt string"


def corpus(spark, n=6):
    return [(b, c, s, f"{b} word{c} and {s}") for b in ("Gen", "Exo", "Lev", "1 Sam/uel") for c in range(1, n) for s in range(1, 8)]


def test_diff_of_written_snapshots(spark, tmp_path):
    rows = corpus(spark) + [(None, 1, 1, "x"), ("Gen", None, 1, "y"), ("Gen", 1, 99, None)]
    new = [r for r in rows if r[:3] not in (("Exo", 2, 3),) and r[0] != "Lev"] + [("Num", 1, 1, "new"), ("Gen", 3, 99, ""), (None, 1, 2, "z")]
    new = [(*r[:3], "changed") if r[:3] == ("1 Sam/uel", 4, 2) else (*r[:3], "") if r[:3] == ("Gen", 1, 99) else r for r in new]
    a, b = (str(tmp_path / x) for x in "ab")
    old_df, new_df = spark.createDataFrame(rows, V), spark.createDataFrame(new, V)
    snapshots.write_snapshot(old_df, a)
    snapshots.write_snapshot(new_df, b)
    plain = [r for r in parallel.snapshot_diff(old_df.where("engs IS NOT NULL AND chap IS NOT NULL"), new_df.where("engs IS NOT NULL AND chap IS NOT NULL")).collect()]
    got = [r for r in snapshots.stored_diff(spark, a, b).collect() if r["engs"] is not None and r["chap"] is not None]
    assert sorted(map(str, got)) == sorted(map(str, plain)) and len(got) > 5
    chapters = {tuple(r) for r in snapshots.differing_chapters(spark, a, b).collect()}
    assert chapters == {("Exo", 2), ("1 Sam/uel", 4), ("Num", 1), ("Gen", 3), ("Gen", 1), (None, 1)} | {("Lev", c) for c in range(1, 6)}
    assert snapshots.stored_diff(spark, a, a).collect() == []


def test_only_texts_of_changed_chapters_are_read(spark, tmp_path):
    rows = [(f"B{k:02}", c, s, "t" * 50 + str(s)) for k in range(8) for c in range(1, 41) for s in range(1, 4)]
    new = [(*r[:3], "new") if r[:2] == ("B03", 7) else r for r in rows]
    a, b = (str(tmp_path / x) for x in "ab")
    snapshots.write_snapshot(spark.createDataFrame(rows, V), a)
    snapshots.write_snapshot(spark.createDataFrame(new, V), b)
    diff = snapshots.stored_diff(spark, a, b)
    assert diff.count() == 3
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = snapshots.stored_diff(spark, a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.split("\n") if "verses]" in line]
    assert len(scans) == 2
    for scan in scans:
        assert "B03" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(chap,7)" in scan


def document(path):
    return b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/document/part-*")))


def test_files_end_to_end_are_the_document(spark, tmp_path):
    rows = corpus(spark) + [("Gen", 9, 1, None), ("Gen", 9, 2, 'quote " back \\ line \n end é 😀'), ("Unknown", 1, 1, "x")]
    books = [("Gen", 1), ("Exo", 2), ("Lev", 3), ("1 Sam/uel", 9), ("Empty", 4)]
    v, b = spark.createDataFrame(rows, V), spark.createDataFrame(books, "engs string, id int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as ranges
    try:
        corpus_document.write_corpus_document(v, b, "kjv", 'a "producer"', str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = document(tmp_path)
    want = [{"engs": e, "chapters": [{"chap": c, "verses": [{"sec": s, "txt": t} for x, y, s, t in sorted(rows[:-1], key=lambda r: r[2]) if (x, y) == (e, c)]} for c in sorted({r[1] for r in rows if r[0] == e})]} for e in ("Gen", "Exo", "Lev", "1 Sam/uel")]
    assert json.loads(whole) == {"version": "kjv", "producer": 'a "producer"', "text": want}
    places = corpus_document.read_places(spark, str(tmp_path)).collect()
    assert len(places) == 4 * 5 + 1
    for p in places:
        assert f'"chap":{p["chap"]},'.encode() in whole[p["begin"] : p["begin"] + p["bytes"]] and whole[p["begin"] + p["bytes"]] == 10
    assert len(glob.glob(f"{tmp_path}/document/part-*")) > 1


def test_document_without_books(spark, tmp_path):
    corpus_document.write_corpus_document(spark.createDataFrame([], V), spark.createDataFrame([], "engs string, id int"), "v", "p", str(tmp_path))
    assert json.loads(document(tmp_path)) == {"version": "v", "producer": "p", "text": None}


def test_search_by_pairs_finds_what_a_scan_finds(spark, tmp_path):
    rows = corpus(spark) + [("Gen", 50, 1, None), ("Gen", 50, 2, ""), ("Gen", 50, 3, "a"), ("Gen", 50, 4, "神 愛 世 人 😀😀!"), ("Gen", 50, 5, "abab"), ("Gen", 50, 6, "ba ab a%b_c")]
    v = spark.createDataFrame(rows, V)
    table = store.pair_index(spark, str(tmp_path / "pairs"))
    table.refresh(lambda: search.postings(v), "one")
    for key in ("word3", "Gen word2 and 7", "aba", "ab", "神 愛", "😀!", "a%b_c", "zz", "no such key", "a", "", "word\\"):
        want, got = keyword_verses(v, key), search.keyword_search(table.read(), v, key)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), key


def test_search_reads_the_lists_of_its_pairs_only(spark, tmp_path):
    v = spark.createDataFrame(corpus(spark), V)
    table = store.pair_index(spark, str(tmp_path / "pairs"))
    table.refresh(lambda: search.postings(v), "one")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = search.candidates(table.read(), "word3")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(pair" in plan.split("PushedFilters")[1]
