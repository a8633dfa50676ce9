"""Operators on documents against brute-force versions on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontam, langid, line_dedup, near_dedup, packing, passages, quality, rules, textkit
from lectern.llm.components import components
from lectern.llm.queries import packed_documents, word_tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, drops string, rank int, centre string, hash string, hashes string, held_out string"
LABELS = "doc_id long, quality int, toxic int, text string"


def table(spark, rows):
    """Rows (doc_id, text) as documents, with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, "y", "z", "z", "h") for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies with a few words changed, passages in other texts, and odd texts."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    for k in range(40):
        words = texts[k % 20].split()
        for _ in range(1 + k % 4):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(words))
    shared = prose(rng, 70)
    texts += [f"{prose(rng, 80)} {shared} {prose(rng, 40)}" for _ in range(6)]
    texts += [texts[0]] * 5 + ["", None, "   \n\t ", "one", "One", "one two three four", "a b c d e", prose(rng, 30_000), "é" * 50, "word " * 400]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3]), (None, None)]
    rng.shuffle(rows)
    return rows


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(text or "")]
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates(spark, corpus):
    got = near_dedup.near_duplicates(table(spark, corpus)).collect()
    assert len(got) == len(corpus)
    sets = {i: shingles(t) for i, t in corpus if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_near_duplicates_beyond_the_star(spark):
    """A chain of texts, each near only to its neighbours, is one component, though few are near to the least id."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words[rng.randrange(200)] = f"y{i}"
        words[rng.randrange(200)] = f"z{i}"
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_line_dedup(spark, corpus):
    rng = random.Random(9)
    lines = [prose(rng, rng.randrange(1, 12)) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*lines, "", " "]) for _ in range(rng.randrange(1, 14)))) for i in range(60)] + [(99, None), (98, ""), (97, "\n\n"), (96, "a"), (None, "a\nb")]
    rows += [rows[5]]
    seen, drop = {}, collections.defaultdict(set)
    for i, t in sorted({r for r in rows if r[0] is not None and r[1]}):
        kept = [k for k, x in enumerate(t.split("\n")) if WORDS.search(x)]
        for a in range(len(kept)):
            for b in range(a + 1, len(kept) + 1):
                run = tuple(t.split("\n")[k] for k in kept[a:b])
                if len(WORDS.findall(" ".join(run))) >= 10 and seen.setdefault(run, (i, a)) != (i, a):
                    drop[i].update(kept[a:b])
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in got:
        t = texts[r["doc_id"]][0]
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[r["doc_id"]])
        assert (r["text"], r["n_removed"], r["n_lines"]) == (want, len(drop[r["doc_id"]]), 0 if t is None else t.count("\n") + 1)
    assert line_dedup.edited_documents(table(spark, corpus)).count() == len(corpus)


def test_fingerprints_are_guaranteed():
    """Every run of ten words or more has a fingerprint, at the same place wherever it stands."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        run, hashes = rng.integers(1, 8, rng.integers(1, 12)), rng.integers(0, 6, 12).astype(np.uint64)
        if run.sum() < 10:
            continue
        seen = []
        for _ in range(2):
            before, after = rng.integers(1, 8, rng.integers(0, 6)), rng.integers(1, 8, rng.integers(0, 6))
            words = np.r_[before, run, after]
            h = np.r_[rng.integers(0, 6, len(before)), hashes[: len(run)], rng.integers(0, 6, len(after))].astype(np.uint64)
            start, end = line_dedup.word_windows(words, np.array([len(words)]), 10)
            at = line_dedup.fingerprints(h, start, end)
            inside = (start >= len(before)) & (end <= len(before) + len(run))
            seen.append(set((at[inside] - len(before)).tolist()))
        assert seen[0] and seen[0] == seen[1]


def test_decontamination(spark, corpus):
    rng = random.Random(4)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 5, 6, 12, 30, 60, 200))] + [(50, None), (51, ""), (None, "a b c d e"), (4, prose(rng, 8))]
    text = dict(items[:7])
    docs = list(corpus) + [(1000 + k, f"{prose(rng, 400)}\n{t.upper().replace(' ', ', ')} {prose(rng, 30)}") for k, t in text.items()]
    docs += [(2000, " ".join(text[5].split()[:52])), (2001, " ".join(text[5].split()[:30])), (2002, prose(rng, 20_000) + " " + text[4])]
    plain = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)})(plain(t))
    item_sets = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            item_sets[i] |= grams(t)
    want = set()
    for d, t in docs:
        if d is not None:
            own = grams(t)
            want |= {(d, i, len(s), len(s & own)) for i, s in item_sets.items() if s and 100 * len(s & own) >= 80 * len(s)}
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    got = decontam.contaminated(table(spark, docs), bench).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    left = decontam.decontaminated(table(spark, docs), bench)
    assert left.count() == len([d for d, _ in docs if d not in {w[0] for w in want}])
    plan = decontam.contaminated(table(spark, docs), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "InArrow" not in plan


def test_passages(spark, corpus):
    got = passages.repeated_passages(table(spark, corpus)).collect()
    words = {i: WORDS.findall((t or "").lower()) for i, t in corpus if i is not None}
    first, covered = {}, collections.defaultdict(set)
    for r in got:
        a, b = words[r["doc_id"]], words[r["source_doc_id"]]
        mine, theirs = a[r["start"] : r["start"] + r["n_words"]], b[r["source_start"] : r["source_start"] + r["n_words"]]
        x, y = shingles(" ".join(mine)), shingles(" ".join(theirs))
        assert len(mine) >= 50 and abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
        assert (r["source_doc_id"], r["source_start"]) < (r["doc_id"], r["start"])
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["n_words"]))
    for i in sorted(words):
        for a in range(len(words[i]) - 49):
            part = tuple(words[i][a : a + 50])
            if first.setdefault(part, (i, a))[0] != i:
                assert set(range(a, a + 50)) <= covered[i]


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(prose(rng, 12) + "." for _ in range(6)) if i % 3 else "\n".join("#$% " * 9 + prose(rng, 3) for _ in range(6))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "t") for i in range(300)] + [(None, 1, 0, "t"), (5, None, 0, "t")], LABELS)
    odd = [(900, None), (901, ""), (902, "\n \n"), (None, "a b c"), (903, "word " * 50_000), (1, rows[1][1])]
    got = quality.score_quality(table(spark, rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    none = quality.score_quality(table(spark, rows[:9]), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


def test_language(spark):
    rng = random.Random(2)
    vocabulary = {"en": "the of thing that with er tion".split(), "de": "der und schlecht ungen heit öfter mit".split(), "fr": "le de eaux tion été qui êtes".split()}
    make = lambda lang, n: " ".join("".join(rng.choices(vocabulary[lang], k=rng.randrange(1, 3))) for _ in range(n))
    rows = [(i, make(("en", "de", "fr")[i % 3], rng.randrange(20, 60)), ("en", "de", "fr")[i % 3]) for i in range(240)]
    odd = [(900, None, "en"), (901, "123 !? \n", None), (902, "«»", "de"), (None, "the thing", None), (903, make("de", 30_000), None), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, held_out string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["lang_pred"] == lang for i, _, lang in rows) >= 235
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and by[900]["score"] == 0
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang IS NULL")).collect()} == {"und"}
    # words of a text that changes language get their own labels
    model = langid.train(docs)
    words = langid.Words(*textkit.raw(textkit.texts_of(__import__("pyarrow").array([make("en", 40) + " " + make("de", 40)]))))
    node = langid.marginals(words.scores(model.tables), langid.Lattice(words.per), model.trans, model.start)
    picked = [model.langs[k] for k in node.argmax(1)]
    assert picked[:35].count("en") > 30 and picked[-35:].count("de") > 30


def test_rules(spark, corpus):
    rows = list(corpus) + [(5000, "a b c a b c\n\nx\nx\n y \n#$ É 1"), (5001, "the of and " * 40), (5002, "\x0b\x0c a\tb \xa0")]
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in rules.judge(table(spark, rows)).collect()}
    assert rules.judge(table(spark, rows)).count() == len(rows)
    for i, t in rows:
        t = t or ""
        w = WORDS.findall(t)
        r = got[i, len(w), sum(map(len, w))]
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        n = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k for a in range(len(w) - 2) if n[tuple(w[a : a + 3])] > 1 for k in (a, a + 1, a + 2)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        assert (r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed)
        assert not (failed and r["kept"])
    plan = rules.judge(table(spark, rows))._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "ArrowEvalPython" not in plan


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    corpus = [*corpus, (7000, "a <|endoftext|> b"), (7001, "x<|startoftext|>y |> <|"), (7002, "<|ENDOFTEXT|>|")]
    got = packed_documents(table(spark, corpus)).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = collections.Counter()
    for i, t in corpus:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[i, piece, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1.01 * sum(r["length"] for r in got) / 2048 + 1


def test_packed_ids(spark, corpus):
    """Sequences hold the ids of their pieces, end to end."""
    from tokenizers import Tokenizer

    some = [(i, t) for i, t in corpus if i is not None and i != 3][:60]
    plain, text = Tokenizer.from_file(word_tokenizer()), dict(some)
    rows = packing.pack_documents(table(spark, some), word_tokenizer()).collect()
    assert sorted((p["doc_id"], p["start"]) for r in rows for p in r["pieces"] if p["start"] == 0) == sorted((i, 0) for i in text)
    for r in rows:
        got, at = np.frombuffer(bytes(r["ids"]), "<u4").tolist(), 0
        assert len(got) <= 2048
        for p in r["pieces"]:
            ids = [*plain.encode(text[p["doc_id"]] or "", add_special_tokens=False).ids, 0]
            assert at == p["offset"] and got[at : at + p["length"]] == ids[p["start"] : p["start"] + p["length"]]
            at += p["length"]
        assert at == len(got)
    read_back = packing.placements(packing.pack_documents(table(spark, some), word_tokenizer())).drop("sequence_id", "offset").collect()
    assert collections.Counter(map(tuple, read_back)) == collections.Counter(map(tuple, packed_documents(table(spark, some)).drop("sequence_id", "offset").collect()))


def test_packing_passes_other_columns_on(spark):
    pieces = spark.createDataFrame([(i, 0, 500 + i, "b", "p", "r", "k", 7, 8) for i in range(40)], "doc_id long, piece int, length long, before string, part string, rank string, key string, sequence_id long, offset long")
    got = packing.pack(pieces).collect()
    assert len(got) == 40 and {(r["before"], r["part"], r["rank"], r["key"]) for r in got} == {("b", "p", "r", "k")} and len({r["sequence_id"] for r in got}) <= 13


def test_tokens_of_odd_chunks():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    chunks = packing.LatinIds(tokenizer)
    odd = ["don't DON'T I'LL ''s it's.", "áb É é́", "İst ΑΣ ΣΣ. ß ªº", "x\x1cy z w q\x85r", "<|endoftext|> a<|startoftext|>b", "12345 ½ ² ٣ _a_b", "日本語 テスト👍🏽", "Ÿ µ \xa0", "\x00 a", "a" * 99, "A'Sb 're", "…“q” —x", "the,' a!'s THE!! ou*** a|", "São-Tomé? (x)"]
    for text in [*odd, " ".join(odd)]:
        assert np.frombuffer(packing.text_ids(text, chunks), "<u4")[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_plans_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5, 1.5, 3000).astype(int), 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    used = np.zeros(2049, int)
    planned = packing.plan(histogram)
    for pattern, n in planned:
        assert sum(pattern) <= 2048 and n > 0
        np.add.at(used, list(pattern), n)
    assert (used == histogram).all()
    assert sum(n for _, n in planned) <= 1.01 * -(-lengths.sum() // 2048) + 1
    by_patterns = sum(sum(pattern) * n for pattern, n in packing.fitted(histogram)[0])
    assert by_patterns > 0.7 * lengths.sum()


def test_empty_tables(spark):
    none = table(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([], LABELS)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        near_dedup.near_duplicates(none), line_dedup.dedup_lines(none), decontam.contaminated(none, bench), passages.repeated_passages(none),
        quality.score_quality(none, labels), langid.identify(none), rules.judge(none), packed_documents(none),
    ):
        assert df.collect() == []
    assert decontam.contaminated(table(spark, [(1, "a b c d e")]), bench).collect() == []


def test_similar_sets_share_bands():
    """The chance that a pair at the threshold shares no band, measured on random pairs of several sizes."""
    rng = np.random.default_rng(1)
    missed = 0
    for n in (8, 20, 60, 400):
        for _ in range(60):
            extra = max(1, int(n * 0.15))
            base = np.unique(rng.integers(0, 1 << 63, n + extra, dtype=np.uint64) * np.uint64(2))
            a, b = base, np.delete(base, rng.choice(len(base), max(1, int(len(base) * 0.13)), False))
            keys = near_dedup.band_keys([a, b])
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "quality_classifier":
            rejected = {r[0] for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").collect()}
            assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()} - rejected
        if name == "minhash_near_dedup":
            assert out.count() == near_dedup.near_duplicates(docs).where("kept").count()
        if name == "benchmark_decontamination":
            assert decontam.contaminated(out, spark.read.parquet(f"{sf}/benchmark.parquet")).isEmpty()
        if name == "best_fit_packing":
            assert out.selectExpr("explode(doc_ids) AS doc_id").distinct().count() == docs.count()
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_hot_groups(spark):
    """A third of all rows are copies, and one line stands in most texts."""
    rng = random.Random(8)
    common = prose(rng, 12)
    rows = [(i, f"{prose(rng, 30)}\n{common}\n{prose(rng, 30)}") for i in range(200)] + [(i, f"{common}\n{common} end of it") for i in range(200, 300)]
    kept = near_dedup.near_duplicates(table(spark, rows)).where("kept").count()
    assert kept == 201
    assert line_dedup.dedup_lines(table(spark, rows)).where("n_removed > 0").count() == 299
