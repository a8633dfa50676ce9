"""Rules of the pipeline's stages against brute force."""

import collections
import random
import re

import corpus_pipeline
from lectern.llm import line_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_chars long"


def prose(rng, n, vocabulary=50_000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t) if t else 0) for i, t in rows], SCHEMA)


def test_line_dedup_of_whole_runs(spark):
    """Every repeated run of ten words or more, of any number of lines."""
    rng = random.Random(7)
    short = [prose(rng, rng.randrange(1, 5)) for _ in range(6)]
    lines = short + [prose(rng, 12), prose(rng, 9)]
    rows = [(i, "\n".join(rng.choice([*lines, "", prose(rng, 2)]) for _ in range(rng.randrange(1, 16)))) for i in range(60)] + [(90, None), (91, ""), (92, lines[6])]
    verse = "\n".join(prose(rng, 3) for _ in range(20))
    rows += [(93, verse), (94, f"{prose(rng, 30)}\n{verse}\n{prose(rng, 30)}")]
    seen, drop = {}, collections.defaultdict(set)
    for i, t in sorted(r for r in rows if r[1]):
        texts = t.split("\n")
        kept = [k for k, x in enumerate(texts) if WORDS.search(x)]
        for a in range(len(kept)):
            for b in range(a + 1, len(kept) + 1):
                run = tuple(texts[k] for k in kept[a:b])
                if len(WORDS.findall(" ".join(run))) >= 10 and seen.setdefault(run, (i, a)) != (i, a):
                    drop[i].update(kept[a:b])
    got = {r["doc_id"]: r for r in line_dedup.edited_documents(frame(spark, rows)).collect()}
    assert len(drop[94]) == 20 and drop[92] == {0}
    for i, t in rows:
        want = t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i])
        assert (got[i]["text"], got[i]["n_removed"]) == (want, len(drop[i]))
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, frame(spark, rows), "").collect()}
    assert 92 not in staged and staged[94] == got[94]["text"]


def shingles(text):
    words = WORDS.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates_at_80_percent(spark):
    rng = random.Random(12)
    rows = []
    for k in range(30):
        words = prose(rng, 100).split()
        rows.append((10 * k, " ".join(words)))
        for i in range(1, 4):
            near = list(words)
            for at in rng.sample(range(5, 95), 1 + (k + i) % 4):
                near[at] = f"x{rng.randrange(9999)}"
            rows.append((10 * k + i, " ".join(near)))
    sets = {i: shingles(t) for i, t in rows}
    root, between = {i: i for i in sets}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and 100 * common >= 80 * both:
                between += 100 * common < 85 * both
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), "").collect()}
    assert between and kept == {i for i in sets if find(i) == i}
