"""Main-text extraction from HTML by boosted trees over DOM nodes (operator 3).

A page becomes a light tree of its elements.  Boosted trees score each element
from its own and its surroundings' features, and a pass over the tree chooses
the labelling of the highest total score in which nothing below a dropped
element is kept.  The trees are trained here, on pages that ``pages_for_training``
writes from a seed: their parts are known, so no table is needed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
RAW = frozenset("script style template noscript iframe svg textarea select option button head title audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    # formulas, which stand in a sentence
    "math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split()
)
#: Elements that may stand in a head; any other one closes it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements that an opening tag of the same group closes.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where that closing stops.
SCOPE = frozenset("ul ol dl table body html article section div nav aside main header footer form blockquote".split())
GROUPS = {
    "main": "article main",
    "text": "p blockquote pre",
    "title": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol dl li dt dd",
    "table": "table thead tbody tr td th",
    "nav": "nav menu",
    "edge": "header footer",
    "side": "aside dialog",
    "form": "form fieldset label input",
    "box": "div section figure figcaption details object canvas",
    "inline": " ".join(sorted(INLINE)),
}
GROUP = {tag: k for k, tags in enumerate(GROUPS.values(), 1) for tag in tags.split()}
#: Tokens of class, id, role and the like that the features count.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner bar breadcrumb breadcrumbs captcha comment comments consent contact cookie cookies copyright "
    "disclaimer disqus foot footer form gdpr head header hidden login masthead menu menus modal nav navbar navigation newsletter notice notification overlay pager "
    "pagination popup privacy promo promoted promotion rail recommended related reply respond search share sharing side sidebar signup site skip social sponsor "
    "sponsored subscribe tags toolbar top widget widgets complementary contentinfo toc teaser outbrain taboola".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry main post prose story text page paragraph copy".split())
FEATURES = 26
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a short heading over what readers wrote.
READERS = frozenset("comment comments reply replies response responses discussion kommentar kommentare commentaire commentaires comentarios commenti".split())

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_MARK = re.compile("[>\"']")
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=50_000)
def _kinds(word: str) -> tuple[int, int]:
    """Whether a token is, begins or ends with a word of either list; short ones count only whole."""
    def of(known: frozenset[str]) -> int:
        return int(word in known or any(word[:k] in known or word[-k:] in known for k in range(5, len(word))))

    return of(BAD_WORDS), of(GOOD_WORDS)


class Node:
    __slots__ = ("tag", "words", "up", "block", "scope", "parts", "depth", "index", "own", "text", "links", "below", "marks", "row", "named")

    def __init__(self, tag: str, words: tuple[str, ...], up: Node | None):
        self.tag, self.words, self.up = tag, words, up
        #: The nearest element above that is not inline, and the depth of the nearest one, itself included, where implied closing stops.
        self.block: Node | None = None if up is None else up.block if up.tag in INLINE else up
        self.parts: list[Node | str] = []
        self.depth = up.depth + 1 if up else 0
        self.scope = self.depth if tag in SCOPE or up is None else up.scope
        self.index = self.own = self.text = self.links = self.below = self.marks = self.row = self.named = 0


class _Tags:
    """Where tags end: at the first ``>`` outside quotes; a quote that nothing closes is a character like others.

    Every quoted part is walked over once, whatever the tags are, so the time is
    in proportion to the page.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()

    def after(self, at: int) -> int:
        """The place after the next ``>``, or -1."""
        return self.html.find(">", at) + 1 if at <= self.last[">"] else -1

    def end(self, at: int) -> int:
        """The place after the tag whose name ends at ``at``; -1 if there is no ``>`` at all."""
        first = self.after(at) - 1
        if first < 0:
            return -1
        part = self.html[at:first]
        for quote, other in (("\"", "'"), ("'", "\"")):
            if other not in part and part.count(quote) % 2 == 0:
                return first + 1
        seen = []
        while at <= self.last[">"] and (m := _MARK.search(self.html, at)):
            if m.start() in self.dead:
                break
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            at = self.html.find(m[0], m.end()) + 1 if m.start() < self.last[m[0]] else m.end()
        self.dead.update(seen)
        return first + 1  # all other ones are quoted


def parse(html: str) -> Node:
    """The tree of ``html``: any string gives one, whatever its tags do."""
    root = node = Node("#root", (), None)
    opened: dict[str, list[Node]] = {}
    tags = _Tags(html)
    at, size = 0, len(html)

    def leave(last: Node) -> None:
        """Closes all up to ``last``."""
        nonlocal node
        while node is not last:
            opened[node.tag].pop()
            node = node.up
        opened[node.tag].pop()
        node = node.up

    while at < size:
        m = _OPEN.search(html, at)
        comment = m and m[0] == "<!--"
        end = at
        if comment:
            close = html.find("-->", m.end())
            end = close + 3 if close >= 0 else size
        elif m:
            end = tags.end(m.end()) if m[2] else tags.after(m.end())
        if end < 0:  # nothing ends any more: the rest is text, up to a comment
            far = html.find("<!--", m.end())
            m, size = None, far if far >= 0 else size
        text = html[at : m.start() if m else size]
        if node.tag == "head" and text and not text.isspace():
            leave(node)
        if text:
            node.parts.append(text)
        if not m:
            break
        at = end
        if comment or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag) and not (tag in INLINE and node.tag not in INLINE):
                last = opened[tag][-1]
                if tag not in INLINE or last.depth > node.block.depth:
                    leave(last)
            continue
        if node.tag == "head" and tag not in HEAD:
            leave(node)
        for other in CLOSES.get(tag, ()):
            if opened.get(other) and opened[other][-1].depth > node.scope:
                leave(opened[other][-1])
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else size
            continue
        attrs = html[m.end() : end - 1]
        words = tuple(w for a in _ATTR.findall(attrs) for w in _WORD.findall((a[0] or a[1] or a[2]).lower())) if "=" in attrs else ()
        new = Node(tag, words, node)
        node.parts.append(new)
        if tag not in VOID and not attrs.endswith("/"):
            opened.setdefault(tag, []).append(new)
            node = new
    return root


def measure(root: Node) -> list[Node]:
    """The elements that are not inline, parents first, with their totals filled in."""
    order: list[Node] = []
    stack = [root]
    while stack:
        n = stack.pop()
        order.append(n)
        k = named = 0
        for p in n.parts:
            if isinstance(p, str):
                size = len(p) - p.count(" ") if not p.isspace() else 0
                n.own += size
                n.marks += p.count(".") + p.count(",")
            else:
                p.index = k
                k += 1
                if p.tag in HEADINGS:
                    words = " ".join(x for x in p.parts if isinstance(x, str)).lower().split()
                    named = int(len(words) <= 4 and any(w.strip(":()0123456789") in READERS for w in words))
                p.named = named
                stack.append(p)
    for n in reversed(order):
        n.text += n.own
        if n.tag == "a":
            n.links = n.text
        if n.up:
            n.up.text += n.text
            n.up.links += n.links
            n.up.marks += n.marks
            n.up.below += n.below + 1
            if n.tag in INLINE:
                n.up.own += n.own
    return [n for n in order if n.tag not in INLINE]


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each of ``measure``'s nodes."""
    out = np.zeros((len(nodes), FEATURES))
    above: dict[int, tuple[int, int, int, int, int, int]] = {}
    total = max(1, nodes[0].text) if nodes else 1
    for k, n in enumerate(nodes):
        n.row = k
        bad = sum(_kinds(w)[0] for w in n.words)
        good = sum(_kinds(w)[1] for w in n.words)
        up = n.block
        b, g, nav, art, edge, named = above.get(id(up), (0, 0, 0, 0, 0, 0))
        group = GROUP.get(n.tag, 0)
        side = n.tag in ("nav", "aside", "form", "menu", "dialog", "button", "select")
        above[id(n)] = (b + (bad > 0), g + (good > 0), nav + side, art + (n.tag in ("article", "main")), edge + (group == 7), named + n.named)
        kin = len(up.parts) if up else 1
        out[k] = (
            group, n.tag in RAW, bad, good, b, g, nav, art, edge, side, n.depth, n.index, kin, n.below,
            np.log1p(n.text), np.log1p(n.own), n.text / (n.below + 1), n.links / (n.text + 1), n.marks / (n.text + 1),
            n.text / total, n.text / (up.text + 1) if up else 1.0, (up.text - n.text) / kin if up else 0.0, n.index / kin, len(n.words), n.named, named,
        )
    return out


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """The labelling of the highest score in which a kept node's ancestors are kept."""
    best = score.copy()
    for k in range(len(nodes) - 1, 0, -1):
        if best[k] > 0:
            best[nodes[k].block.row] += best[k]
    keep = np.zeros(len(nodes), bool)
    for k, n in enumerate(nodes):
        up = n.block
        keep[k] = n.tag not in RAW and (up is None or (keep[up.row] and best[k] > 0))
    return keep


def blocks(root: Node, keep: np.ndarray) -> list[str]:
    """The kept text in page order, one string for each run of inline content."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if text := _SPACE.sub(" ", unescape("".join(run))).strip():
            out.append(text)
        run.clear()

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        n, k = stack.pop()
        inline = n.tag in INLINE
        if k == 0 and not inline:
            close()
        while k < len(n.parts):
            p = n.parts[k]
            k += 1
            if isinstance(p, str):
                run.append(p)
            elif p.tag == "br":
                run.append(" ")
            elif p.tag in INLINE or (keep[p.row] and p.tag not in RAW):
                stack += [(n, k), (p, 0)]
                break
            else:
                close()
        else:
            if not inline:
                close()
    return out


def _sentence(rng: random.Random, least: int, most: int) -> str:
    words = ["".join(rng.choices(("ta", "re", "mi", "lo", "an", "es", "un", "che", "der", "in", "ou", "é"), k=rng.randint(1, 4))) for _ in range(rng.randint(least, most))]
    return " ".join(w + ("," if rng.random() < 0.1 else "") for w in words).capitalize() + "."


def pages_for_training(count: int, seed: int = 3) -> Iterator[str]:
    """Pages whose kept elements carry the attribute ``data-keep``."""
    rng = random.Random(seed)
    pick = rng.choice

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{_sentence(rng, 1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def junk() -> str:
        name = pick(["menu", "navbar", "sidebar", "ad", "ads banner", "cookie-notice", "promo", "newsletter", "related-posts", "share social", "breadcrumb", "widget", "subscribe", "notice", "popup", "site-header", "site-footer", "login-form", "comments", "advert", "sponsored", "masthead", "toolbar"])
        tag = pick(["div", "div", "section", "aside", "nav", "header", "footer", "form"])
        attr = pick([f' class="{name}"', f' id="{name}"', f' class="{name}"', "" if tag in ("nav", "aside", "footer", "form", "header") else f' class="{name}"'])
        inner = pick([
            lambda: links(rng.randint(2, 10)),
            lambda: _sentence(rng, 3, 30),
            lambda: "".join(f"<p>{_sentence(rng, 3, 40)}</p>" for _ in range(rng.randint(1, 4))),
            lambda: f"<h3>{_sentence(rng, 1, 4)}</h3>" + links(rng.randint(2, 6)),
            lambda: f"<div><p>{_sentence(rng, 5, 40)}</p><div>{_sentence(rng, 1, 5)}</div></div>",
            lambda: f'<label>{_sentence(rng, 1, 3)}<input name="q"></label><button>{_sentence(rng, 1, 2)}</button>',
        ])
        return f"<{tag}{attr}>{inner()}</{tag}>"

    def comments() -> str:
        wrote = lambda: pick([f"<p>{_sentence(rng, 1, 40)}</p>", _sentence(rng, 1, 40), f"<b>{_sentence(rng, 1, 2)}</b><p>{_sentence(rng, 4, 40)}</p>", f'<div class="author">{_sentence(rng, 1, 2)}</div><div>{_sentence(rng, 2, 60)}</div>'])
        n = rng.randint(1, 5)
        head = pick(["", f"<h2>{_sentence(rng, 1, 3)}</h2>", f"<{pick(sorted(HEADINGS))}>{pick(['', '3 ', 'All '])}{pick(sorted(READERS)).capitalize()}{pick(['', ':', ' (2)'])}</h2>"])
        each = "".join(f'<div class="{pick(["comment", "comment", "reply", "response-body"])}">{wrote()}</div>' for _ in range(n))
        items = "".join(f"<li{pick(['', ' class=comment', ' id=c1'])}>{wrote()}</li>" for _ in range(n))
        listed = pick(["commentlist", "comment-list", "commentslist", "replies", "disqus_thread", "usercomments"])
        return pick([
            f'<section id="comments">{head}{each}</section>',
            f'<div class="comments-area">{head}{each}</div>',
            f'{head}<ol class="{listed}">{items}</ol>',
            f'<div id="{listed}">{head}<ul>{items}</ul></div>',
            f"<{(h := pick(sorted(HEADINGS)))}>{pick(sorted(READERS)).capitalize()}</{h}><ul>{items}</ul>",
        ])

    def body() -> str:
        out = []
        if rng.random() < 0.8:
            title = f"<h1 data-keep>{_sentence(rng, 2, 10)}</h1>"
            out.append(title if rng.random() < 0.8 else f"<header data-keep>{title}</header>")
        for _ in range(pick([1, 2, 4, 8, 16])):
            out.append(pick([
                lambda: f"<p data-keep>{_sentence(rng, 2, 90)}</p>",
                lambda: f"<p data-keep>{_sentence(rng, 5, 120)} <a href='x'>{_sentence(rng, 1, 4)}</a></p>",
                lambda: f"<p data-keep>{_sentence(rng, 1, 160)}",
                lambda: f"<p data-keep><b>{_sentence(rng, 3, 30)}<br>",
                lambda: f"<h2 data-keep>{_sentence(rng, 1, 8)}</h2>",
                lambda: "<ul data-keep>" + "".join(f"<li data-keep>{_sentence(rng, 2, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
                lambda: f"<blockquote data-keep><p data-keep>{_sentence(rng, 4, 60)}</p></blockquote>",
                lambda: "<table data-keep>" + "".join(f"<tr data-keep><td data-keep>{_sentence(rng, 1, 4)}</td><td data-keep>{_sentence(rng, 1, 4)}</td></tr>" for _ in range(3)) + "</table>",
                lambda: f"<div data-keep>{_sentence(rng, 4, 80)}</div>",
                lambda: f"<pre data-keep>{_sentence(rng, 4, 30)}</pre>",
                lambda: junk() if rng.random() < 0.4 else f"<p data-keep>{_sentence(rng, 10, 60)}</p>",
            ])())
        if rng.random() < 0.3:
            out.append(comments())
        return "".join(out)

    for _ in range(count):
        name = pick(["content", "article-body", "post", "entry-content", "story", "main", "prose"])
        inner = body()
        main = pick([
            f"<article data-keep>{inner}</article>",
            f"<main data-keep><article data-keep>{inner}</article></main>",
            f"<main data-keep>{inner}</main>",
            f'<div data-keep class="{name}">{inner}</div>',
            f'<div data-keep id="{name}"><div data-keep>{inner}</div></div>',
            f'<section data-keep class="{name}">{inner}</section>',
            f"<div data-keep>{inner}</div>",
        ])
        before = "".join(junk() for _ in range(rng.randint(0, 4)))
        after = "".join(junk() for _ in range(rng.randint(0, 4))) + (comments() if rng.random() < 0.2 else "")
        wrap = pick(["", "", "wrapper", "container", "page"])
        page = before + main + after
        yield "<html data-keep><body data-keep>" + (f'<div data-keep class="{wrap}">{page}</div>' if wrap else page) + pick(["</body></html>", ""])


@lru_cache(maxsize=1)
def trained(pages: int = 1200) -> Boosted:
    """The trees, trained once a process; the same ones everywhere."""
    rows, labels, weights = [], [], []
    for html in pages_for_training(pages):
        root = parse(html.replace(" data-keep", ' role="keepme"'))
        kept = []
        nodes = measure(root)
        for n in nodes:
            kept.append(n is root or "keepme" in n.words)
            n.words = tuple(w for w in n.words if w != "keepme")
        rows.append(features(nodes))
        labels += kept
        weights += [1.0 + np.log1p(n.text) for n in nodes]
    return fit(np.concatenate(rows), np.array(labels, float), np.array(weights))


def extract(pages: list[str], model: Boosted) -> list[str]:
    """The main text of each page, scored together."""
    roots = [parse(p) for p in pages]
    nodes = [measure(r) for r in roots]
    score = model.score(np.concatenate([features(n) for n in nodes])) if nodes else np.zeros(0)
    out, at = [], 0
    for root, some in zip(roots, nodes, strict=True):
        part = score[at : at + len(some)]
        at += len(some)
        out.append("\n".join(blocks(root, decode(some, part))))
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row; null and empty pages give empty text.

    A map without a shuffle.  Whole pages are read whatever their length; other
    columns are not read.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = extract([x or "" for x in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("html"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars bigint"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
