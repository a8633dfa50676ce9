"""Exact round trips of formatted conversations, and main texts of pages in known and unseen layouts."""

import hashlib
import random

import pyarrow as pa
import pytest

from lectern.llm import chat, html

ALPHABET = ["<|im_start|>", "<|im_end|>", "\n", "\\", "<", "[INST]", "é", "</s>", "[", "a", "|im_end|>", "im_end|>\n", "😀", "<<SYS>>"]


def test_assembled_bytes_round_trip():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(1, 6)
        conv = sorted(rng.randint(0, 2) for _ in range(n))
        roles = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 3))) if rng.random() < 0.5 else "assistant" for _ in range(n)]
        texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 8))) for _ in range(n)]
        rows = chat.assemble(conv, pa.array(roles, pa.large_string()), pa.array(texts, pa.large_string())).to_pylist()
        assert [t for r in rows for t in chat.parse(r["formatted"])] == list(zip(roles, texts))
        loss = [chat.unescape(r["formatted"][a:b]) for r in rows for a, b in zip(r["loss_starts"], r["loss_ends"])]
        assert loss == [t for r, t in zip(roles, texts) if r == "assistant"]
        # control strings stand only where the template puts them
        found = [sum(r["formatted"].count(c.decode()) for r in rows) for c in chat.CONTROLS]
        assert found == [n, n] + [0] * (len(chat.CONTROLS) - 2)


def test_broken_format_is_an_error():
    with pytest.raises(ValueError):
        chat.parse("<|im_start|>user\nx")


def test_conversations(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "x" * 3000, "</s>[INST] ok [/INST]", "é\\"]), "clash") for c in range(80) for t in range(rng.randrange(1, 9))]
    rows += [(5, 0, "user", "tie", "c"), (5, 0, "user", "tie", "c"), (7, None, "user", "no turn", "c"), (None, 0, "assistant", "no id", "c"), (500, 0, "assistant", "y" * 400_000, "c")]
    rows += [(600, k, "user", f"{k}", "c") for k in range(25_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    order = lambda r: [(x is not None, x) for x in r[1:4]]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted((x for x in rows if x[0] == c), key=order)
        whole = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(df.limit(0))).collect() == []


WORDS = "the of and thing tion ment that with was for blend erst which heart ring under".split()


def sentences(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(rng, k):
    paragraphs = [sentences(rng, rng.randrange(12, 40)) for _ in range(rng.randrange(2, 6))]
    body = "".join(f"<p>{p.replace('and', '&amp;')}</p>" for p in paragraphs)
    links = "".join(f'<li><a href="/x">{rng.choice(WORDS)}</a></li>' for _ in range(5))
    source = f'<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{links}</ul></nav><div class="ad">{sentences(rng, 6)}</div><article><h1>Title {k}</h1>{body}</article><footer>&copy; {sentences(rng, 4)}</footer></body></html>'
    return source, "\n".join([f"Title {k}", *[p.replace("and", "&") for p in paragraphs]])


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(6)
    return [page(rng, k) for k in range(120)]


def test_pages(spark, pages):
    rows = [(k, f"u{k}", s, "clash") for k, (s, _) in enumerate(pages)]
    odd = [(900, "u", None, "c"), (901, None, "", "c"), (902, "u", "<script>x</script><p>", "c"), (None, "u", pages[0][0], "c"), (0, "u0", pages[0][0], "c"), (903, "u", "<<<a <b \"' &amp", "c")]
    long_ = (904, "u", pages[1][0].replace("<p>", "<p>" + "the thing " * 20_000, 1), "c")
    df = spark.createDataFrame([*rows, *odd, long_], "page_id long, url string, html string, text string")
    got = html.extract_text(df).collect()
    assert len(got) == len(rows) + len(odd) + 1 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert [by[k] for k in range(120)] == [t for _, t in pages]
    assert by[900] == by[901] == by[902] == "" and by[None] == pages[0][1] and len(by[904]) > 190_000
    assert html.extract_text(df.limit(0)).collect() == []


def test_unseen_layouts(pages):
    model = html.Model([s for s, _ in pages[:60]])
    runs = sorted({t for s, _ in pages for t in html.Page(s).text if t})
    right = 0
    for p, main in html.layouts(runs, 150, seed=77):
        forest = html.Forest([p])
        keep = forest.decode(model.trees.margins(forest.features)) & forest.is_run
        right += [t for t, k in zip(p.text, keep) if k] == [t for t, k in zip(p.text, main) if k]
        # no kept node below a dropped one
        whole = forest.decode(model.trees.margins(forest.features))
        assert all(whole[forest.parent[i]] or forest.parent[i] == 0 for i in range(1, len(whole)) if whole[i])
    assert right >= 130


def test_page_structure():
    p = html.Page("<body>a <b>b</b><br>c<div>d<p>e<p>f</div>g <i>h</i>&nbsp;&lt;i<script>no</script>j<ul><li>k<li>l</ul><!-- no --><table><tr><td>m<td>n</table><hr>o<x-y>q")
    assert [t for t in p.text if t] == ["a b c", "d", "e", "f", "g h <i j", "k", "l", "m", "n", "o", "q"]
