"""The word rule of op7: languages of the table, a fifth one once it has rows, and noise."""

import random

from lectern.llm import rules

SF = "/root/testdata/sf0.01"
SWEDISH = "och i att det som en på är av för med till den har de inte om ett men var jag sig från vi".split()


def swedish(rng, n):
    stems = "hus väg skog kvinna vatten bok himmel arbete stad sommar berg flod".split()
    words = [rng.choices(SWEDISH, weights=[1 / (k + 1) for k in range(24)])[0] if rng.random() < 0.4 else rng.choice(stems) + rng.choice(["", "en", "et", "ar", "erna"]) + rng.choice(["", "", ",", "."]) for _ in range(n)]
    return " ".join(words)


def judged(spark, rows):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return {r["doc_id"]: r for r in rules.judge(given.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}


def test_a_fifth_language_and_noise(spark):
    rng = random.Random(5)
    letters = lambda: " ".join("".join(rng.choices("abcdefghijklmnoprstuv", k=rng.randint(2, 9))) for _ in range(170))
    noise = [(-100 - k, letters(), None) for k in range(5)]
    asked = [(-1 - k, swedish(rng, 168), None) for k in range(5)]
    without = judged(spark, noise + asked)
    assert not any(without[k]["kept"] for k, _, _ in noise + asked)
    rows = [(-1000 - k, swedish(rng, rng.randint(60, 300)), "sv") for k in range(40)]
    held = judged(spark, noise + asked + rows)
    assert all(held[k]["kept"] for k, _, _ in asked + rows) and not any(held[k]["kept"] for k, _, _ in noise)
    assert all(held[k]["word_distance"] == 1 for k, _, _ in noise)


def test_clean_documents_of_the_table_stay(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in judged(spark, []).values() if not r["base_failed"] and r["n_words"] >= rules.MIN_COUNTED_WORDS]
    good, bad = [r for r in got if labels.get(r["doc_id"]) == 1], [r for r in got if labels.get(r["doc_id"]) == 0]
    assert len(good) > 200 and all(r["kept"] for r in good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert max(r["word_distance"] for r in good) < rules.MAX_WORD_DISTANCE - 0.05  # the bound is not near what occurs


def test_tables_without_languages_or_common_words(spark):
    rows = [(1, "a b c " * 60, None), (2, None, "en"), (3, "", "en"), (4, "1 2 3 4 5 6 7 8 9 " * 20, "en")]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1]["n_words"] == 180 and got[2]["word_distance"] == 0 and got[4]["word_distance"] == 1
    alone = rules.judge(spark.createDataFrame(rows[:1], "doc_id long, text string, lang string")).first()
    assert alone["word_distance"] == 0 and alone["char_distance"] == 0
