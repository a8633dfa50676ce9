"""Queries that need a part of the texts, or the texts once, do not store or gather more than that."""

import glob
import json

from pyspark.sql import functions as F

from lectern.operators import nesting, search
from lectern.operators.lookup import keyword_verses
from lectern.plans import registry, views
from lectern.plans.views import Corpus
from lectern.sources import landing

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def own_folder(monkeypatch, tmp_path):
    for module in (landing, views):
        monkeypatch.setattr(module, "landing_base", lambda spark: str(tmp_path))


def test_one_search_makes_no_index_and_uses_one_that_is_there(spark, monkeypatch, tmp_path):
    own_folder(monkeypatch, tmp_path)
    c, found = Corpus(spark, SF), {}
    for name, key in (("keyword_verses", "small_ring"), ("keyword_scan", "z")):
        found[key] = sorted(map(tuple, registry.QUERIES[name](spark, SF).collect()))
        assert found[key] == sorted(map(tuple, keyword_verses(c.verses_plain, key).collect()))
    assert not glob.glob(f"{tmp_path}/stored/*")
    c.pair_index("verses_plain")
    used = []
    monkeypatch.setattr(search, "candidates", lambda index, key, own=search.candidates: used.append(key) or own(index, key))
    for key, rows in found.items():
        assert sorted(map(tuple, c.keyword_search("verses_plain", key).collect())) == rows
    assert used == ["small_ring"]


def test_chapters_of_a_book_read_no_texts(spark, monkeypatch, tmp_path):
    own_folder(monkeypatch, tmp_path)
    df = registry.QUERIES["distinct_chapters"](spark, SF)
    assert "l_orderkey" not in plan_of(df) and "txt" not in plan_of(df) and not glob.glob(f"{tmp_path}/*")


def test_views_of_some_chapters(spark, monkeypatch):
    c, asked = Corpus(spark, SF), spark.createDataFrame([(3,), (7,), (7,), (9999999,), (None,)], "chap int")
    for limit in (views.LOOKED_UP_ORDERS, -1):
        monkeypatch.setattr(views, "LOOKED_UP_ORDERS", limit)
        for name in ("verses_tagged", "verses_b"):
            got, want = getattr(c.of_chapters(asked), name), getattr(c, name).where("chap IN (3, 7)")
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 2


def test_requests_store_no_texts(spark, monkeypatch, tmp_path):
    own_folder(monkeypatch, tmp_path)
    assert registry.QUERIES["chapter_requests"](spark, SF).count() > 0
    assert not glob.glob(f"{tmp_path}/stored/*")


def test_the_corpus_is_put_together_from_texts_of_books(spark):
    rows = [(b, c, s, None if s == 2 else f'{b} "{c}" {s} \\ 神') for b in ("Exo", "Gen", 'Q"u', "Odd") for c in (12, 3, 1) for s in (3, 1, 2)]
    v = spark.createDataFrame(rows, "engs string, chap int, sec int, txt string").repartition(5)
    b = spark.createDataFrame([("Gen", 1), ("Exo", 2), ('Q"u', 3)], "engs string, id int")
    df = nesting.nest_corpus(v, b, 'k"jv', "null}")
    books = [{"engs": e, "chapters": [{"chap": c, "verses": [{"sec": s, "txt": None if s == 2 else f'{e} "{c}" {s} \\ 神'} for s in (1, 2, 3)]} for c in (1, 3, 12)]} for e in ("Gen", "Exo", 'Q"u')]
    want = {"version": 'k"jv', "producer": "null}", "text": books}
    got = df.first()["doc"]
    assert json.loads(got) == want and got == json.dumps(want, separators=(",", ":"), ensure_ascii=False)
    last = next(x for x in plan_of(df).splitlines() if "Aggregate" in x)
    assert "collect_list" in last and "to_json" not in last.split("collect_list")[1] and "chapters" not in last.split("collect_list")[1].split("AS doc")[0]
    assert nesting.nest_corpus(v, b.where(F.lit(False)), "x", "y").first()["doc"] == '{"version":"x","producer":"y","text":null}'
