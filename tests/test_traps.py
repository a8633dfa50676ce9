"""Hand-written rows for each trap; expected values are fixed by the texts."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import align, lexicon, lookup, nesting, parallel
from lectern.operators.numbering import numbered
from lectern.plans.views import Corpus
from lectern.sources import corpus_json, payloads, sqlite

SF = "/root/testdata/sf0.001"
V = "engs string, chap int, sec int, txt string"


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_lenient_int(spark):
    assert column(spark, ["5238a", "abc", "", "05238", None], fn.lenient_int) == [5238, 0, 0, 5238, None]


def test_pad_key(spark):
    assert column(spark, ["493", "5238a", "123456"], fn.pad_key) == ["00493", "05238a", "123456"]


def test_tags(spark):
    text = "{<WG1722>}word<WTH0853>x<H123>y<3478>z<WG123456>"
    assert column(spark, [text], fn.all_tags) == [["<WG1722>", "<WTH0853>", "<H123>"]]
    assert column(spark, ["{<WG1722>}", "<WTH0853>", "<3478>"], fn.canonical_tag) == ["G1722", "H853", None]
    assert column(spark, ["{<WG1722>}word<WTH0853>x"], fn.strip_tags) == ["wordx"]
    assert column(spark, ["<3478>", "a", None], fn.has_loose_tag) == [True, False, None]
    assert column(spark, ["<3478>", None], fn.has_tag) == [False, False]


def test_annotate(spark):
    df = spark.sql("SELECT 'the earth was earth' AS t, array(named_struct('sn','H776','word','earth'), named_struct('sn','H430','word','zzz'), named_struct('sn','H1','word','earth')) AS s")
    assert df.select(fn.annotate(F.col("t"), F.col("s"))).first()[0] == "the earth (H1) (H776) was earth"


def test_small_texts(spark):
    assert column(spark, ["Song of Songs", "1 Samuel"], fn.book_slug) == ["songofsongs", "1samuel"]
    assert column(spark, ["1 Samuel", "a!'()~*"], fn.percent_encoded) == ["1%20Samuel", "a!'()~*"]
    assert column(spark, ["12 text", "1 a\n2 b"], fn.strip_verse_number) == ["text", "a\nb"]
    assert column(spark, ["short"], fn.text_preview) == ["short..."]


def test_null_text_stays(spark):
    v = spark.createDataFrame([("Gen", 1, 1, None), ("Gen", 1, 2, "a")], V)
    assert nesting.nest_chapter(v).first()["verses"] == '[{"sec":1,"txt":null},{"sec":2,"txt":"a"}]'
    assert lookup.untagged_residual(v).count() == 2
    b = spark.createDataFrame([("Exo", 1)], "engs string, id int")
    assert json.loads(nesting.nest_corpus(v, b, "x", "y").first()["doc"])["text"] is None


def test_lexicon_traps(spark, tmp_path):
    x = spark.createDataFrame([(1, s, int(s[:5]), "o", "f", "t") for s in ("05238b", "05238", "00010", "05238a")], "dic_type int, sn string, num int, orig string, orig_alt string, txt string")
    assert [r["sn"] for r in lexicon.lexicon_natural_order(x).orderBy("place").collect()] == ["00010", "05238", "05238a", "05238b"]
    for bad in ((5, 5), (6, 5)):
        with pytest.raises(ValueError):
            lexicon.lexicon_range(x, *bad)
    assert not corpus_json.write_lexicon_json(x, 11, 12, "ot", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert lexicon.lexicon_array(x, 11, 12).first()["doc"] is None
    assert {r["sn"] for r in lexicon.lexicon_suffix_probe(x, 5237, 5238).collect()} == {"05238", "05238a", "05238b"}
    assert [r["num"] for r in lexicon.lexicon_gaps(x, 10, 11).collect()] == [11]


def test_payload_without_record(spark):
    p = spark.createDataFrame([('{"status":"success","record":[]}',), ('{"status":"error"}',), ("no json",)], "payload string")
    assert payloads.flatten_lexicon_payload(p).collect() == [(None, None, None, None)]
    assert payloads.payload_success_count(p).first()["success_count"] == 1


def test_mixed_verse_is_in_neither(spark):
    v = spark.createDataFrame([("a", 1, 1, "x<H123>y<G123>"), ("a", 1, 2, "x<H123>")], V)
    n = lookup.tag_line_counts(v).first()
    assert (n["n_tagged"], n["n_only_h"], n["n_only_g"]) == (2, 1, 0)


def test_invariants(spark):
    c = Corpus(spark, SF)
    n = lookup.tag_line_counts(c.verses_tagged).first()
    assert n["n_tagged"] == n["n_only_h"] + n["n_only_g"]
    assert n["n_tagged"] + lookup.untagged_residual(c.verses_tagged).count() == c.verses_tagged.count()
    assert parallel.tag_strip_check(c.verses_tagged, c.verses_plain).isEmpty()
    found, gaps = lexicon.lexicon_range_probe(c.lexicon, 0, 199).where("sn IS NOT NULL").count(), lexicon.lexicon_gaps(c.lexicon, 0, 199).count()
    assert found + gaps == 200
    spans = align.tagged_spans(c.verses_tagged)
    assert spans.count() == c.lineitem.count()


def test_plans(spark):
    c = Corpus(spark, SF)
    plan = lookup.canonical_join(c.verses_tagged, c.main)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    scan = lookup.distinct_books(c.verses_tagged)._jdf.queryExecution().executedPlan().toString()
    assert "p_brand" not in scan  # columns are pruned down to the scan


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "snapshot.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE kjv (engs, chap, sec, txt)")
    db.executemany("INSERT INTO kjv VALUES (?, ?, ?, ?)", [("Gen", i // 10, i % 10, f"t{i}" if i else None) for i in range(57)])
    db.commit()
    db.execute("CREATE TABLE empty (engs)")
    db.commit()
    spark.dataSource.register(sqlite.SqliteSnapshot)
    df = spark.read.format("sqlite_snapshot").schema(V).option("path", path).option("table", "kjv").load()
    assert df.rdd.getNumPartitions() == 4 and df.count() == 57
    assert df.where("chap = 3 AND sec >= 5").count() == 5
    pushing = spark.read.format("sqlite_snapshot").schema(V).option("path", path).option("table", "kjv").option("pushdown", "true").load()
    assert pushing.where("chap = 3 AND sec >= 5").count() == 5 and pushing.where("txt IS NULL").count() == 1
    parts = sqlite.to_snapshots(df, "kjv", ["engs", "chap", "sec", "txt"], 10)
    assert sqlite.write_files(parts, str(tmp_path / "files")) == 8  # four partitions of 15, 15, 15 and 12 rows, ten in a file
    folder = spark.read.format("sqlite_snapshot").schema(V).option("path", str(tmp_path / "files")).option("table", "kjv").load()
    assert folder.exceptAll(df).isEmpty() and df.exceptAll(folder).isEmpty()
    assert df.where("txt IS NULL").count() == 1
    assert spark.read.format("sqlite_snapshot").schema("engs string").option("path", path).option("table", "empty").load().count() == 0
    assert sqlite.snapshot_files(spark, path, "kjv", V, {"chap": 5}).count() == 7


def test_corpus_round_trip(spark, tmp_path):
    c = Corpus(spark, SF)
    corpus_json.write_corpus_json(c.verses_tagged, c.main, "kjv", str(tmp_path / "out"))
    back = corpus_json.read_corpus_json(spark, str(tmp_path / "out")).drop("version")
    want = lookup.canonical_join(c.verses_tagged, c.main).drop("id")
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()


def test_stored_tables_are_pruned(spark):
    c = Corpus(spark, SF)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    chapter = plan(lookup.chapter_verses(c.stored("verses_tagged"), "NATION_19", 1))
    assert "(engs" in chapter.split("PartitionFilters")[1] and "EqualTo(chap,1)" in chapter and "lineitem" not in chapter
    assert "GreaterThanOrEqual(num,40)" in plan(lexicon.lexicon_range(c.stored("lexicon"), 40, 120))
    assert "EqualTo(sn,00013a)" in plan(lexicon.lexicon_entry(c.stored("lexicon"), "00013a"))
    assert c.stored("verses_tagged").exceptAll(c.verses_tagged).isEmpty() and c.verses_tagged.exceptAll(c.stored("verses_tagged")).isEmpty()


def test_numbered_over_many_ranges(spark):
    rows = [(None if k % 5 == 4 else k % 5, k * 7919 % 1000) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, x int").repartition(7)
    got = numbered(df, "g", ["x"], "place").collect()
    for g in (0, 1, 2, 3, None):
        own = sorted((r["place"], r["x"]) for r in got if r["g"] == g)
        assert [p for p, _ in own] == list(range(1, 601)) and [x for _, x in own] == sorted(x for h, x in rows if h == g)
    assert numbered(df.limit(0), "g", ["x"], "place").collect() == []


def test_model1_on_a_known_text(spark):
    """One number stands in both verses and so goes with the word that does; rounds end when nothing moves any more."""
    tagged = spark.createDataFrame([("a", 1, 1, "x<H101>y<H102>"), ("a", 1, 2, "x<H101>z<H103>")], V)
    plain = spark.createDataFrame([("a", 1, 1, "la maison"), ("a", 1, 2, "la fleur")], V)
    pairs = align.candidate_pairs(tagged, plain)
    p = [{(r["word"], r["sn"]): r["p"] for r in align.model1_em(pairs, rounds).collect()} for rounds in (1, 2, 5)]
    assert p[0]["la", "H101"] == 0.5 and p[0]["la", "H101"] < p[1]["la", "H101"] < p[2]["la", "H101"] and p[2]["maison", "H102"] > 0.7
    stopped = align.model1_em(pairs, 40, 0.05)
    assert {r["word"]: r["sn"] for r in align.best_alignment(pairs, stopped).collect()} == {"la": "H101", "maison": "H102", "fleur": "H103"}
    assert align.model1_em(pairs.limit(0)).collect() == []
