"""A key that very many texts share is dealt to several tasks, also where no side is small enough for a broadcast."""

import random

import pytest

from lectern.llm import near_dedup, passages
from lectern.llm.tables import written

SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def no_broadcasts(spark, monkeypatch):
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    for module in (passages, near_dedup):
        monkeypatch.setattr(module, "sized", lambda df, *_: written(df, "side"))
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_windows_of_a_passage_in_very_many_texts(spark, no_broadcasts):
    """The join of windows with the first text of their key is a skewed one, after it has run."""
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = words(60)
    docs = spark.createDataFrame([(k, f"{words(5)} {shared} {words(5)}") for k in range(3000)], "doc_id long, text string").repartition(4)
    windows = written(docs.mapInArrow(passages._windows, passages._WINDOWS), "windows")
    plans = []
    seen = passages._listed

    def listed(rows):
        rows.count()
        again = rows.select("doc_id", "source", "span", "crowded")
        again.collect()
        plans.append(again._jdf.queryExecution().executedPlan().toString())
        return seen(rows)

    passages._listed = listed
    try:
        found = passages.repeated_passages(docs)
    finally:
        passages._listed = seen
    assert windows.count() >= 9000 and "skew=true" in plans[0]
    assert found.select("doc_id").distinct().count() == 2999
    assert found.where("n_words >= 60 AND source_doc_id = 0").select("doc_id").distinct().count() == 2999


def test_a_template_of_many_unlike_texts_gives_the_links_of_brute_force(spark):
    rng = random.Random(2)
    template = " ".join(f"t{k}" for k in range(150))
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(70)) for _ in range(600)]
    rows = [(k, f"{template} {x}") for k, x in enumerate(own)]
    rows += [(1000 + k, f"{template} {own[k]} end") for k in range(0, 60, 3)] + [(2000 + k, f"{template} {own[k]} two more ends here") for k in range(0, 60, 6)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k: k for k in range(600)} | {1000 + k: k for k in range(0, 60, 3)} | {2000 + k: k for k in range(0, 60, 6)}
    assert got == want


def test_prefixes_of_alike_sets_meet():
    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, near_dedup.SLOTS).astype(np.int32)
    for _ in range(300):
        percent = int(rng.choice([80, 85]))
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 90)), dtype=np.uint64))
        drop, more = int(rng.integers(0, max(1, len(a) // 8) + 1)), int(rng.integers(0, len(a) // 8 + 1))
        b = np.unique(np.r_[rng.permutation(a)[drop:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
        if len(b) and near_dedup.similar(len(a), len(b), len(np.intersect1d(a, b)), percent):
            assert len(np.intersect1d(near_dedup.prefix(a, counts, percent), near_dedup.prefix(b, counts, percent)))
