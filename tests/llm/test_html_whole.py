"""Text of pages that used to be dropped unseen."""

import pytest

from assetspark.llm import html

ARTICLE = "<article><h1>A title of it</h1><p>First paragraph of the article, with some words, and more of them.</p><p>Second paragraph of it, as long as the first one.</p></article>"


@pytest.mark.parametrize("start", ["<html><head><title>no</title><meta charset=utf-8><body>", "<html><head><link rel=x href=y><title>no</title>", "<head><head><body>"])
def test_html_head_left_open(start):
    want = "A title of it\nFirst paragraph of the article, with some words, and more of them.\nSecond paragraph of it, as long as the first one."
    assert html.extract([start + ARTICLE, "<html><head><title>no</title></head><body>" + ARTICLE], html.trained()) == [want, want]


def test_html_text_in_a_head_left_open():
    assert [p for p in html.parse("<head><title>no</title>\n some text").parts if isinstance(p, str)] == ["\n some text"]


def test_html_formulas_and_fallbacks():
    formula = "<math><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math>"
    page = f"<html><body>{ARTICLE}".replace("</article>", f"<p>So we get {formula} from the words before it, as it was said.</p>")
    page += "<object data=x><p>The chart shows a long rise of all figures, and then a fall.</p></object>"
    page += "<canvas><p>The drawing shows a house of two floors, a tree, and a fence.</p></canvas></article>"
    text = html.extract([page], html.trained())[0]
    assert "So we get E=mc2 from the words" in text and "The chart shows" in text and "The drawing shows" in text
