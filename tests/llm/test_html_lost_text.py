"""Formulas are text, and an article without any mark is one."""

import pytest

from lectern.llm import html


@pytest.fixture(scope="module")
def model(spark):
    return html.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_formulas_stay(model):
    body = "The bound is <math><semantics><mrow><mi>x</mi><mo>&lt;</mo><mn>5</mn></mrow><annotation>x \\lt 5</annotation></semantics></math> here, as was shown before in the text."
    page = f"<html><body><article><h1>On bounds</h1><p>{body}</p><p>The second part says why it holds, in some more words.</p></article></body></html>"
    assert model.extract([page]) == ["On bounds\nThe bound is x<5 here, as was shown before in the text.\nThe second part says why it holds, in some more words."]


def test_plain_divs(model):
    lines = ["The first of three plain lines.", "The second one, of the same kind.", "And the third one."]
    plain = "".join(f"<div>{x}</div>" for x in lines)
    around = '<div class="menu"><a href="/">Home</a></div>{}<div class="footer">Copyright, all rights.</div>'
    assert model.extract([plain, f"<html><body>{plain}</body></html>"]) == ["\n".join(lines)] * 2
    assert set(model.extract([around.format(plain)])[0].split("\n")) == set(lines)


def test_pages_without_an_article_stay_empty(model):
    menu = '<nav><ul><li><a href="/a">Home.</a></li><li><a href="/b">News, all of them</a></li></ul></nav>'
    assert model.extract([menu, f"<body>{menu}<footer>Copyright, all rights reserved.</footer></body>", "<p><a href='/x'>A link, and nothing else.</a></p>", "<body>   </body>", None]) == [""] * 5
