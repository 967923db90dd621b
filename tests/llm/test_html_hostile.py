"""HTML: hostile pages take time in proportion to their length, and pages of layouts that the trees were not trained on."""

import time

import pytest

from assetspark.llm import html

ODD = {
    "open tags": "<a " * 60_000,
    "quoted ends": '<a ">" ' * 60_000,
    "mixed quotes": "<a '\">\"' " * 40_000 + ">",
    "inline nesting": "<b>" * 60_000 + "<p>x</p>" * 20_000 + "</i>" * 60_000,
    "block nesting": "<div>" * 100_000 + "x",
    "closing inline": "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000,
    "comments": "<!--" * 60_000,
    "list items": "<ul>" + "<li>" * 60_000,
}


@pytest.mark.parametrize("name", ODD)
def test_time_is_linear(name):
    model, began = html.trained(), time.time()
    html.extract([ODD[name]], model)
    assert time.time() - began < 20


def test_depth_changes_nothing():
    page = "<article><p>Some text of an article, long enough to be kept, with commas.</p></article>"
    deep = "<div>" * 3000 + page + "</div>" * 3000
    tags = []
    n = html.parse(deep)
    while n.parts:
        n = next(p for p in n.parts if not isinstance(p, str)) if not isinstance(n.parts[0], str) else None
        if n is None:
            break
        tags.append(n.tag)
    assert tags == ["div"] * 3000 + ["article", "p"]


def words(k, n=40):
    return " ".join(f"word{(k * 37 + j * 11) % 997}" for j in range(n)) + "."


BLOG = f"""<!doctype html><html><head><title>T</title></head><body class="home single"><div id="page"><header id="masthead"><a href="/">Blog</a><nav id="site-navigation"><ul class="menu">
<li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></nav></header><div id="primary"><article class="post hentry"><h1 class="entry-title">{words(1, 6)}</h1><div class="entry-content">
<p>{words(2)}</p><p>{words(3)}</p><h2>{words(4, 4)}</h2><p>{words(5)}</p></div></article><div id="comments" class="comments-area"><h2>2 Comments</h2><ol class="commentlist"><li>{words(90, 9)}</li><li>{words(91, 12)}</li></ol>
<form action="/reply"><textarea name="c"></textarea></form></div></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent</h2><ul><li><a href="/1">{words(92, 4)}</a></li></ul></section></aside>
<footer id="colophon"><p>{words(93, 8)}</p></footer></div></body></html>"""
NEWS = f"""<html><body><div class="cookie-consent"><p>{words(94, 12)}</p><button>OK</button></div><div class="topbar"><a href=/>Home</a> <a href=/x>World</a></div><main><article>
<header><h1>{words(6, 8)}</h1></header><p>{words(7, 50)}</p><figure><figcaption>{words(8, 9)}</figcaption></figure><div class="ad-slot advert"><p>{words(95, 10)}</p></div><p>{words(9, 50)}</p>
<ul><li>{words(10, 9)}</li><li>{words(11, 9)}</li></ul><p>{words(12, 45)}</p></article><section class="related-articles"><h3>More</h3><ul><li><a href="/r1">{words(96, 6)}</a></li><li><a href="/r2">{words(97, 6)}</a></li></ul></section></main>
<div class="newsletter-signup"><p>{words(98, 9)}</p><form><input name="mail"></form></div><footer><a href="/i">Imprint</a></footer></body></html>"""
PLAIN = f"<html><body><h1>{words(13, 5)}</h1><p>{words(14, 60)}</p><p>{words(15, 60)}</p><p>{words(16, 30)}</p></body></html>"
DOCS = f"""<html><body><div class="sidebar"><ul>{''.join(f'<li><a href="/{k}">{words(100 + k, 3)}</a></li>' for k in range(12))}</ul></div><div class="main-content" role="main"><h1>{words(17, 3)}</h1><p>{words(18)}</p>
<pre>{words(19, 20)}</pre><table><tr><td>{words(20, 3)}</td><td>{words(21, 4)}</td></tr></table><p>{words(22)}</p></div></body></html>"""
#: Page, what must be found, what must not.
UNSEEN = [
    (BLOG, [2, 3, 5], [90, 91, 92, 93]),
    (NEWS, [7, 9, 12], [94, 95, 96, 97, 98]),
    (PLAIN, [14, 15, 16], []),
    (DOCS, [18, 19, 22], list(range(100, 112))),
]
LENGTHS = {90: 9, 91: 12, 92: 4, 93: 8, 7: 50, 9: 50, 12: 45, 94: 12, 95: 10, 96: 6, 97: 6, 98: 9, 14: 60, 15: 60, 16: 30, 19: 20} | {k: 3 for k in range(100, 112)}


@pytest.mark.parametrize("k", range(len(UNSEEN)))
def test_pages_of_other_layouts(k):
    page, kept, gone = UNSEEN[k]
    (text,) = html.extract([page], html.trained())
    for i in kept:
        assert words(i, LENGTHS.get(i, 40)) in text
    for i in gone:
        assert words(i, LENGTHS[i]) not in text.split("\n")


def test_whole_long_page():
    page = "<html><body><article>" + "".join(f"<p>{words(k)}</p>" for k in range(20_000)) + "</article></body></html>"
    (text,) = html.extract([page], html.trained())
    assert text == "\n".join(words(k) for k in range(20_000))
