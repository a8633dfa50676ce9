"""The models against enumeration: fields over all labellings, trees over all splits, decoding over all consistent choices."""

import itertools
import random
import time

import numpy as np
import pytest

from lectern.llm import html, langid
from lectern.llm.boost import BoostedTrees
from lectern.llm.crf import Lattice, forward_backward, gradients, marginals


def by_enumeration(emit, trans, start):
    """Log-normaliser, marginals and the score of a labelling of one sequence."""
    n, labels = emit.shape
    score = lambda y: start[y[0]] + sum(emit[t, y[t]] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n))
    every = list(itertools.product(range(labels), repeat=n))
    scores = np.array([score(y) for y in every])
    weights = np.exp(scores)
    node = np.zeros((n, labels))
    for y, w in zip(every, weights):
        node[np.arange(n), y] += w
    return np.log(weights.sum()), node / weights.sum(), score


@pytest.mark.parametrize("labels", [2, 3])
def test_field_against_all_labellings(labels):
    rng = np.random.default_rng(labels)
    lengths = [3, 0, 5, 1, 4]
    emit, trans, start = rng.normal(0, 2, (sum(lengths), labels)), rng.normal(0, 1, (labels, labels)), rng.normal(0, 1, labels)
    gold = rng.integers(0, labels, sum(lengths))
    lattice = Lattice(lengths)
    got, total, likelihood, at = marginals(emit, lattice, trans, start), 0.0, 0.0, 0
    for n in lengths:
        if n:
            log_z, node, score = by_enumeration(emit[at : at + n], trans, start)
            assert np.allclose(got[at : at + n], node)
            total, likelihood = total + log_z, likelihood + score(gold[at : at + n]) - log_z
        at += n
    assert np.isclose(forward_backward(emit, lattice, trans, start)[3], total)
    value, by_emit, by_trans, by_start = gradients(emit, gold, lattice, trans, start)
    assert np.isclose(value, likelihood)
    for table, slope in ((emit, by_emit), (trans, by_trans), (start, by_start)):
        for i in np.ndindex(table.shape):
            table[i] += 1e-5
            up = gradients(emit, gold, lattice, trans, start)[0]
            table[i] -= 2e-5
            down = gradients(emit, gold, lattice, trans, start)[0]
            table[i] += 1e-5
            assert abs((up - down) / 2e-5 - slope[i]) < 1e-4


def test_first_split_against_all_splits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (200, 4)).astype(float)
    y = ((x[:, 2] > 3) ^ (rng.random(200) < 0.1)).astype(float)
    weight = rng.uniform(0.5, 2, 200)
    tree = BoostedTrees(depth=1, trees=1, bins=32).fit(x, y, weight)
    share = (y * weight).sum() / weight.sum()
    g, h = weight * (y - share), weight * share * (1 - share)
    gain = lambda side: g[side].sum() ** 2 / (h[side].sum() + 1)
    gains = {(k, c): gain(x[:, k] <= c) + gain(x[:, k] > c) for k in range(4) for c in range(7)}
    feature, cut = int(tree.features[0][0]), tree.thresholds[0][0]
    assert np.isclose(gain(x[:, feature] <= cut) + gain(x[:, feature] > cut), max(gains.values())) and feature == 2
    left = x[:, feature] <= cut
    want = tree.base + tree.rate * np.where(left, g[left].sum() / (h[left].sum() + 1), g[~left].sum() / (h[~left].sum() + 1))
    assert np.allclose(tree.margins(x), want)


def test_more_trees_fit_better():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    loss = lambda m: np.logaddexp(0, np.where(y > 0, -m, m)).mean()
    few, many = (BoostedTrees(depth=2, trees=n).fit(x, y, np.ones(400)) for n in (2, 40))
    assert loss(many.margins(x)) < loss(few.margins(x)) / 2 and ((many.margins(x) > 0) == y).mean() > 0.97


def test_decoding_against_all_consistent_choices():
    rng = np.random.default_rng(5)
    for seed in range(30):
        pick = random.Random(seed)
        source = "".join(pick.choice(["<div>", "</div>", "<p>some text here", "<section>", "</section>", "one<br>two ", "<ul><li>a b"]) for _ in range(7))
        forest = html.Forest([html.Page(source)])
        n = len(forest.parent)
        if n > 13:
            continue
        margins = rng.normal(0, 2, n)
        odds = np.clip(margins, -5, 5)
        own = np.where(forest.is_run, forest.size * odds, html.CONTAINER_WEIGHT * forest.sub[:, 0] * odds)
        own[0] = 0
        best = 0.0
        for choice in itertools.product([False, True], repeat=n - 1):
            keep = np.array([True, *choice])
            if (keep[1:] <= keep[forest.parent[1:]]).all():
                best = max(best, own[keep].sum())
        keep = forest.decode(margins)
        assert (keep[1:] <= (keep | (np.arange(n) == 0))[forest.parent[1:]]).all()
        assert np.isclose(own[keep].sum(), best)


@pytest.mark.parametrize("part", ["<a ", "<a '", '<a "', "<svg>", "</svg ", "<b '<b \"", "<!--", "<td><x>", "<x></td>", "<li><div>", "<a b='>' c=\"<", "<p", "<", "</", "&amp", "<x><td></td>"])
def test_malformed_pages_take_time_in_proportion(part):
    def took(n):
        start = time.process_time()
        html.Page("<div>" + part * (n // len(part)) + ">")
        return time.process_time() - start

    small, large = min(took(50_000) for _ in range(3)), took(400_000)
    assert large < 40 * max(small, 0.01)


HAND_MADE = [
    (
        """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><div id="page"><div class="masthead"><a href="/">The Daily</a></div>
        <ul class="navbar"><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Weather</a></li></ul>
        <main><h1>River rises again</h1><p>The river rose by two metres in the night, and the lower streets were closed to all traffic.</p>
        <p>Residents were told to stay at home; a school was opened for those who could not, the mayor said on Sunday.</p></main>
        <div class="related"><h3>More</h3><ul><li><a href="/1">Storm warning</a></li><li><a href="/2">Bridge shut</a></li></ul></div>
        <footer>Copyright 2020 The Daily. All rights reserved.</footer></div></body></html>""",
        "River rises again\nThe river rose by two metres in the night, and the lower streets were closed to all traffic.\n"
        "Residents were told to stay at home; a school was opened for those who could not, the mayor said on Sunday.",
    ),
    (
        """<body><nav><a href=/>Home</a> | <a href=/blog>Blog</a> | <a href=/about>About</a></nav><article><h2>On bread</h2><p>Flour, water, salt &amp; time: that is all it takes,
        but the last of them is what most of us lack.</p><blockquote>A loaf is a day's work, my grandmother used to say, and she was right.</blockquote>
        <p>Start the evening before, and let the dough rest in a cool place until the morning.</p></article>
        <section class="comments"><h3>2 comments</h3><p>Thanks, this worked well for me!</p><p>Mine stayed flat, what did I do wrong?</p></section>
        <form action=/s><label>Subscribe</label><input name=m><button>Go</button></form></body>""",
        "On bread\nFlour, water, salt & time: that is all it takes, but the last of them is what most of us lack.\n"
        "A loaf is a day's work, my grandmother used to say, and she was right.\nStart the evening before, and let the dough rest in a cool place until the morning.",
    ),
    (
        """<html><body><div class="cookie-notice">We use cookies to make this site better. <a href="/c">Learn more</a></div><div class="wrapper"><div class="content post">
        <p>Two trains left the station at noon, one to the north and one to the south, and neither arrived on time.</p><div class="advert">Buy two, get one free, only this week!</div>
        <p>What followed was a week of letters to the editor, most of them angry, some of them funny.</p></div><aside><p>Follow us for more stories like this one.</p></aside></div>
        <script>var x = "<p>not text</p>";</script></body></html>""",
        "Two trains left the station at noon, one to the north and one to the south, and neither arrived on time.\n"
        "What followed was a week of letters to the editor, most of them angry, some of them funny.",
    ),
]


def test_hand_made_layouts():
    """Pages written by hand, with no text or template of the training layouts; the model sees only given pages."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist()
    model = html.Model(sorted(pages)[:60])
    assert model.extract([page for page, _ in HAND_MADE]) == [text for _, text in HAND_MADE]


def test_letters_by_category():
    assert not any(map(langid.has_letter, ["①②③", "Ⅳ", "½ ²", "123 _ -", "", "«»\xa0"])) and all(map(langid.has_letter, ["µ", "ª", "①a", "é", "日", "ʰ"]))


def test_odd_letters_get_a_language(spark):
    rows = [(i, " ".join(random.Random(i).choices(("the of and is".split(), "der die und ist".split())[i % 2], k=30)), ("en", "de")[i % 2]) for i in range(60)]
    odd = [(900, "①②③", None), (901, "Ⅳ", None), (902, "µ", None), (903, "ª", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")).collect()}
    assert got[900] == got[901] == "und" and {got[902], got[903]} <= {"en", "de"}


def test_many_languages(spark):
    """Seventy languages, each with words of its own: all are learned."""
    names = [f"l{k:02d}" for k in range(70)]
    words = {x: ["".join(random.Random(f"{x}{k}").choices("abcdefghijklmnopqrstuvwxyz", k=6)) for k in range(12)] for x in names}
    rows = [(i, " ".join(random.Random(i).choices(words[names[i % 70]], k=25)), names[i % 70]) for i in range(1400)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == set(names) and sum(r["lang_pred"] == names[r["doc_id"] % 70] for r in got) > 1380


@pytest.mark.parametrize("n_words", range(8))
def test_shingles_of_few_words(n_words):
    import pyarrow as pa

    from lectern.llm import textkit

    data = textkit.raw(textkit.texts_of(pa.array([" ".join("abcdefgh"[:n_words]), "", None], pa.string())))
    hashes, per = textkit.shingle_hashes(*textkit.word_hashes(*data), 5)
    assert per.tolist() == [min(n_words, 1) if n_words < 5 else n_words - 4, 0, 0] and len(np.unique(hashes)) == len(hashes) == per.sum()
