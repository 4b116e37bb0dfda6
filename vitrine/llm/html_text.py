"""Main text of web pages from a tree-structured graphical model (operator 1)."""

from __future__ import annotations

import functools
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fixed_values import ATTRIBUTE_WORDS, ENDS_OWN, ENDS_P, INLINE, VOID
from .frames import made, slices

# Comments and elements whose content is no text; tags; other markup; a tag cut off by the end.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])[^>]*/>"
    r"|<(script|style|template|noscript|svg|annotation|annotation-xml|iframe|object|canvas|textarea|select|title|xmp|noembed|noframes)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!?][^>]*\Z", re.S | re.I)
_LABEL = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。][\"'»”)]*\s")

_GROUP = {w: g for g, ws in ATTRIBUTE_WORDS.items() for w in ws}
_TAGS = ("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form button input label fieldset "
         "address details summary head dialog menu other").split()
#: What an element hands down to all below it: the words it is called by, that it is hidden, that it is not the page's main article.
_HANDED = [*[f"says {g}" for g in ATTRIBUTE_WORDS if g != "content"], "hidden", "lesser article"]
_NAMES = [*[f"tag {t}" for t in _TAGS], *[f"says {g}" for g in ATTRIBUTE_WORDS], "hidden", *[f"length {i}" for i in range(5)], *[f"links {i}" for i in range(4)], "sentences",
          "lesser article", "inside article", "inside main", "inside page edge", *[f"under {x}" for x in _HANDED], *[f"share {i}" for i in range(4)], *[f"div length {i}" for i in range(5)], *[f"unmarked {t}" for t in ("div", "p", "heading", "other")]]
FEATURE = {name: i for i, name in enumerate(_NAMES)}
_LAYOUT_WORDS = {FEATURE[f"says {g}"] for g in ("menu", "edge", "side", "social")}
_DOWN = {FEATURE[x]: FEATURE[f"under {x}"] for x in _HANDED}
#: Kinds of child elements, each with its own parent-child potentials, below article or main and elsewhere.
_KIND = {t: 1 for t in "p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split()} | {t: 2 for t in "nav header footer aside form".split()}
KINDS = 6
#: Elements that are no part of an article when they stand outside ``article`` and ``main``, as a rule.
_EDGES = {"nav", "header", "footer", "aside", "form", "dialog"}
_INSIDE = {FEATURE["inside article"], FEATURE["inside main"], FEATURE["inside page edge"]}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@functools.lru_cache(maxsize=20_000)
def _element_features(tag: str, attributes: str) -> tuple[int, ...]:
    out = {FEATURE.get(f"tag {tag}", FEATURE["tag other"])}
    for value in _LABEL.findall(attributes):
        out |= {FEATURE[f"says {_GROUP[w]}"] for w in _WORD.findall(value.lower()) if w in _GROUP}
    if _HIDDEN.search(attributes):
        out.add(FEATURE["hidden"])
    return tuple(out)


class Page:
    """The block elements of a page in page order, each with its parent, and the stretches of text between block borders."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["html"], [-1], [""]
        self.chars, self.linked, self.full = [0], [0], [False]
        self.blocks: list[tuple[int, str]] = []
        stack, held, links, at = [0], [], 0, 0
        opened: dict[str, int] = {}  # how many elements of a tag are open: an end tag without one costs no look at the stack

        def close():
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    node = stack[-1]
                    self.blocks.append((node, text))
                    self.chars[node] += len(text)
                    self.full[node] = self.full[node] or bool(_SENTENCE.search(text + " "))

        def say(piece):
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if links:
                self.linked[stack[-1]] += len(piece.strip())

        def leave():
            opened[self.tags[stack.pop()]] -= 1

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                say(source[at:m.start()])
            at = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            tag, ending = name.lower(), m[2] or m[5]
            if tag in INLINE:
                if tag == "a":
                    links = 0 if ending else 1
                continue
            if tag == "br":
                held.append("\n")
                continue
            close()
            links = 0
            if ending:
                if tag in _HEADINGS and self.tags[stack[-1]] in _HEADINGS:  # an end tag of another level ends a heading too
                    tag = self.tags[stack[-1]]
                if opened.get(tag):
                    while self.tags[stack[-1]] != tag:
                        leave()
                    leave()
                continue
            if tag in ENDS_P and self.tags[stack[-1]] == "p":
                leave()
            family = ENDS_OWN.get(tag)
            while family and len(stack) > 1 and self.tags[stack[-1]] in family:
                leave()
            if tag == "html":
                continue
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.attributes.append(m[4] or m[7] or "")
            self.chars.append(0)
            self.linked.append(0)
            self.full.append(False)
            if tag not in VOID:
                stack.append(len(self.tags) - 1)
                opened[tag] = opened.get(tag, 0) + 1
        if at < len(source):
            say(source[at:])
        close()

    def features(self) -> list[tuple[int, ...]]:
        """Numbers of the features that hold, per element: what it is and is called, what those above it are called, how much of it is text and links.

        Elements that hold the page's heading or ``main`` hand no name down, and of elements with half of the page's text only
        notices, adverts, comments, forms and hidden ones do: a wrapper called "with-sidebar" is no sidebar.
        """
        chars, linked, tags, parents = self.chars[:], self.linked[:], self.tags, self.parents
        for i in range(len(chars) - 1, 0, -1):
            chars[parents[i]] += chars[i]
            linked[parents[i]] += linked[i]
        wraps = [t in ("main", "h1") for t in tags]
        for i in range(len(tags) - 1, 0, -1):
            if wraps[i]:
                wraps[parents[i]] = True
        total = max(1, chars[0] - linked[0])
        largest = max((c for t, c in zip(tags, chars) if t == "article"), default=0)
        unmarked = "article" not in tags and "main" not in tags
        length, link, share, block = FEATURE["length 0"], FEATURE["links 0"], FEATURE["share 0"], FEATURE["div length 0"]
        handed: list[tuple[int, ...]] = []
        out = []
        for i, (tag, attributes, own) in enumerate(zip(tags, self.attributes, self.chars)):
            named = _element_features(tag, attributes)
            if tag == "article" and 2 * chars[i] < largest:
                named += (FEATURE["lesser article"],)
            above = handed[parents[i]] if i else ()
            part = (chars[i] - linked[i]) / total
            new = () if wraps[i] else [_DOWN[f] for f in named if f in _DOWN and (part < 0.5 or f not in _LAYOUT_WORDS) and _DOWN[f] not in above]
            if tag in ("article", "main") and len(named) == 1 and FEATURE[f"inside {tag}"] not in above:
                new = (*new, FEATURE[f"inside {tag}"])
            if tag in _EDGES and not _INSIDE.intersection(above):
                named += (FEATURE["inside page edge"],)
                new = (*new, FEATURE["inside page edge"])
            handed.append((*above, *new) if new else above)
            size = 0 if not own else 1 if own < 25 else 2 if own < 80 else 3 if own < 250 else 4
            of_links = linked[i] / chars[i] if chars[i] else 0
            found = (*named, *above, length + size, link + (0 if of_links == 0 else 1 if of_links < 0.2 else 2 if of_links < 0.6 else 3),
                     share + (0 if part < 0.1 else 1 if part < 0.4 else 2 if part < 0.8 else 3))
            if tag == "div":
                found += (block + size,)
            if unmarked:
                found += (FEATURE["unmarked " + (tag if tag in ("div", "p") else "heading" if tag in _HEADINGS else "other")],)
            if self.full[i]:
                found += (FEATURE["sentences"],)
            out.append(found)
        return out


def kinds_of(page: Page) -> list[int]:
    """Which parent-child potentials hold between each element and its parent."""
    holds = [3 if t in ("article", "main") else 0 for t in page.tags]
    return [_KIND.get(t, 0) + (holds[p] if p >= 0 else 0) for t, p in zip(page.tags, page.parents)]


class TreeModel:
    """Binary labels on a tree: unary potentials from features, parent-child potentials by the kinds of child and parent."""

    def __init__(self):
        self.unary = [0.0] * len(FEATURE)
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(KINDS)]

    def marginals(self, page: Page, features=None):
        """Sum-product upward and downward: each element's probability of being content, and of each pair of labels with its parent."""
        features = features or page.features()
        n, parents, unary = len(page.tags), page.parents, self.unary
        kinds = kinds_of(page)
        one = [sum([unary[f] for f in fs]) for fs in features]  # log potential of label 1; label 0 has 0
        below = one[:]  # with the messages of the children, as a difference of log sums
        up = [0.0] * n
        exp, log = math.exp, math.log
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = self.pair[kinds[i]]
            z = below[i]
            # log sum over the child's label for parent 1, less that for parent 0
            x1, y1, x0, y0 = c, d + z, a, b + z
            m1, m0 = max(x1, y1), max(x0, y0)
            up[i] = m1 + log(exp(x1 - m1) + exp(y1 - m1)) - m0 - log(exp(x0 - m0) + exp(y0 - m0))
            below[parents[i]] += up[i]
        whole = below[:]  # with the message of the parent
        pairs = [None] * n
        for i in range(1, n):
            (a, b), (c, d) = self.pair[kinds[i]]
            out = whole[parents[i]] - up[i]  # the parent without this child
            z = below[i]
            logs = (a, b + z, c + out, d + out + z)
            m = max(logs)
            e = [exp(x - m) for x in logs]
            total = sum(e)
            pairs[i] = [x / total for x in e]
            p1, p0 = e[1] + e[3], e[0] + e[2]
            whole[i] = log(max(p1, 1e-300)) - log(max(p0, 1e-300))
        return [1 / (1 + exp(-max(-700.0, min(700.0, x)))) for x in whole], pairs

    def text(self, source: str | None) -> str:
        """The blocks of elements that are more likely content than not, in page order."""
        if not source:
            return ""
        page = Page(source)
        likely, _ = self.marginals(page)
        return " ".join(text for node, text in page.blocks if likely[node] > 0.5)


def fit(pages: list[str], rounds: int = 120, rate: float = 0.15, decay: float = 2e-5) -> TreeModel:
    """Maximum likelihood from pages whose content elements carry ``data-main``: observed less expected counts, by steps with momentum and a rate per feature."""
    model, known = TreeModel(), []
    for source in pages:
        page = Page(source)
        labels = [int("data-main" in a) for a in page.attributes]
        known.append((page, page.features(), labels, kinds_of(page)))
    unary, pair = np.zeros(len(FEATURE)), np.zeros((KINDS, 4))
    mean, square = np.zeros(unary.size + pair.size), np.zeros(unary.size + pair.size)
    size = sum(len(x[2]) for x in known)
    for step in range(1, rounds + 1):
        up, pp = -decay * unary * size, -decay * pair * size
        for page, features, labels, kinds in known:
            likely, pairs = model.marginals(page, features)
            for i, (fs, y, p) in enumerate(zip(features, labels, likely)):
                for f in fs:
                    up[f] += y - p
                if i:
                    pp[kinds[i]] -= pairs[i]
                    pp[kinds[i], 2 * labels[page.parents[i]] + y] += 1
        slope = np.concatenate([up, pp.ravel()]) / size
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        move = rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        unary, pair = unary + move[:unary.size], pair + move[unary.size:].reshape(pair.shape)
        model.unary, model.pair = unary.tolist(), pair.reshape(KINDS, 2, 2).tolist()
    return model


#: Families of page layouts: where the article stands.
LAYOUTS = ("article", "main", "named", "plain", "bare", "table")


def labelled_pages(n: int = 200, seed: int = 7, layouts: tuple[str, ...] = LAYOUTS) -> list[str]:
    """Pages of common layouts whose content elements are marked ``data-main``: what the model is trained on.

    Layout, names, order and lengths vary by rule; words are invented, so that no words of any corpus matter. The article is
    an element of that name, ``main``, a ``div`` with a telling name, a ``div`` among others without names, not wrapped at
    all, or a table under a heading.
    """
    rng = random.Random(seed)

    def words(a, b):
        return " ".join("".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b))).capitalize()

    def sentences(k):
        return " ".join(words(4, 18) + "." for _ in range(k))

    def links(k):
        return "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(k)) + "</ul>"

    def named(tag, names, inner, plain=0.4):
        name = rng.choice(names)
        return f"<{tag}>{inner}</{tag}>" if tag != "div" and rng.random() < plain else f'<{tag} {rng.choice(["class", "id"])}="{name}">{inner}</{tag}>'

    M = "data-main"

    def paragraphs(k):
        return "".join(f"<p {M}>{sentences(rng.randint(2, 6))}</p>" for _ in range(k))

    def table():
        rows = "".join(f"<tr {M}><td {M}>{words(1, 3)}</td><td {M}>{rng.choice([rng.randint(1, 999), words(1, 3)])}</td></tr>" for _ in range(rng.randint(1, 6)))
        return f"<table {M}>" + rng.choice(["", f"<tr {M}><th {M}>{words(1, 2)}</th><th {M}>{words(1, 2)}</th></tr>"]) + rows + "</table>"

    def contents():
        return named(rng.choice(["nav", "div", "ul"]), ["toc", "table-of-contents", "toc-list"], "".join(f"<li><a href='#{i}'>{words(1, 3)}</a></li>" for i in range(rng.randint(2, 6))), 0)

    def teaser():
        inner = f"<h3>{rng.choice([words(1, 4), f'<a href=x>{words(2, 6)}</a>'])}</h3><p>{words(4, 14)}.</p>"
        return rng.choice([f"<article>{inner}</article>", f"<article class='{rng.choice(['teaser', 'related-post', 'card'])}'>{inner}</article>"])

    def article(layout):
        if layout == "table":
            inner = f"<h1 {M}>{words(1, 4)}</h1>" + rng.choice(["", f"<p {M}>{words(4, 14)}.</p>"]) + table()
            return rng.choice([f"<main {M}>{inner}</main>", f"<article {M}>{inner}</article>", f'<div class="content" {M}>{inner}</div>'])
        parts = [f"<h1 {M}>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        if parts and rng.random() < 0.2:
            parts = [f"<header {M}>{parts[0]}</header>"]
        short = rng.random() < 0.25
        for _ in range(rng.randint(1, 2) if short else rng.randint(1, 9)):
            kind = rng.random() * (0.66 if short else 1)
            text = words(1, 5) + "." if rng.random() < (0.6 if short else 0.15) else sentences(rng.randint(1, 5))
            if kind < 0.66:
                parts.append(f"<p {M}>{rng.choice(['', '<b>'])}{text}" + rng.choice(["</p>", "</p>", "<br>"]))
            elif kind < 0.74:
                parts.append(f"<h{rng.randint(2, 4)} {M}>{words(1, 6)}</h2>")
            elif kind < 0.81:
                parts.append(f"<ul {M}>" + "".join(f"<li {M}>{words(2, 14)}" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote {M}><p {M}>{text}</p></blockquote>")
            elif kind < 0.90:
                parts.append(table())
            elif kind < 0.93:
                parts.append(f"<figure {M}><img src=x><figcaption {M}>{words(3, 9)}</figcaption></figure>")
            elif kind < 0.95:
                parts.append(f"<pre {M}>{words(3, 20)}</pre>")
            else:
                parts.append(rng.choice([advert, side, social, form])())
        if layout in ("plain", "bare"):
            parts.append(paragraphs(rng.randint(1, 2)))
        if rng.random() < 0.15:
            parts.insert(rng.randint(0, len(parts)), advert())
        if rng.random() < 0.2:
            parts.insert(rng.randint(0, min(1, len(parts))), contents())
        if rng.random() < 0.12:
            parts.append(f"<footer>{words(2, 6)}{rng.choice(['', '.'])}</footer>")
        if rng.random() < 0.08:
            parts.insert(rng.randint(0, len(parts)), f"<aside class='{rng.choice(['pullquote', 'note', 'pull-quote'])}'>{rng.choice([sentences(1), f'<p>{sentences(1)}</p>'])}</aside>")
        inner = "".join(parts)
        if layout == "bare":
            return inner
        if layout == "plain":
            whole = rng.choice([f"<div {M}>{inner}</div>", f"<div {M}><div {M}>{inner}</div></div>"])
            if rng.random() < 0.4:
                whole = f"<div {M}>" + "".join(f"<div {M}>{sentences(rng.randint(2, 6))}</div>" for _ in range(rng.randint(1, 5))) + "</div>"
            return whole
        if layout == "article":
            others = "".join(teaser() for _ in range(rng.choice([0, 0, 0, 1, 2, 3])))
            return rng.choice([f"<article {M}>{inner}</article>{others}", f"<main><article {M}>{inner}</article>{others}</main>", f"<main><article {M}>{inner}</article></main>{others}"])
        if layout == "main":
            return f'<main {M} id="main">{inner}</main>' if rng.random() < 0.5 else f"<main {M}>{inner}</main>"
        name = rng.choice(["content", "post-content", "entry-content", "article-body", "story", "main-content", "page-content", "text"])
        return rng.choice([f'<div class="{name}" {M}>{inner}</div>', f'<section {M}><div class="{name}" {M}>{inner}</div></section>'])

    def top():
        return named("header", ["site-header", "masthead", "header"], rng.choice([f"<h1>{words(1, 3)}</h1>", f"<div>{words(1, 4)}</div>", f"<p>{words(3, 9)}</p>", ""]) + rng.choice(["", menu()]))

    def menu():
        return named(rng.choice(["nav", "nav", "div"]), ["nav", "menu", "navbar", "breadcrumb", "pagination"], links(rng.randint(2, 9)))

    def advert():
        return named(rng.choice(["div", "div", "section", "aside"]), ["ad", "ads", "advert", "sponsored", "promo", "banner-ad", "ad-slot", "ad-unit", "top_ad", "sponsored-box"], rng.choice([words(2, 9) + ".", f"<p>{sentences(rng.randint(1, 3))}</p>", f"<a href=x>{words(2, 6)}</a>"]), 0)

    def side():
        return named(rng.choice(["aside", "aside", "div"]), ["sidebar", "widget", "related", "popular"], rng.choice([links(4), f"<h3>{words(1, 3)}</h3>{links(3)}", f"<p>{sentences(2)}</p>"]))

    def notice():
        if rng.random() < 0.2:
            return rng.choice(["<div hidden>", "<div style='display: none'>", "<div aria-hidden=true>"]) + f"<p>{sentences(rng.randint(1, 3))}</p>" + "</div>"
        tag, inner = rng.choice(["div", "section", "dialog"]), f"<p>{sentences(rng.randint(1, 2))}</p><button>{words(1, 2)}</button>"
        return named(tag, ["cookie-notice", "cookie-banner", "consent", "newsletter", "alert", "popup", "paywall"], inner, 0.3 if tag == "dialog" else 0)

    def social():
        return named("div", ["share", "social", "tags"], rng.choice([links(3), f"<a href=x>{words(1, 2)}</a>"]), 0)

    def form():
        return f"<form {rng.choice(['', 'class=search', 'id=login'])}><label>{words(1, 3)}</label><input name=q><p>{words(2, 8)}</p><button>{words(1, 2)}</button></form>"

    def comments():
        each = "".join(rng.choice([f'<div class="comment"><h4>{words(1, 2)}</h4><p>{sentences(rng.randint(1, 3))}</p></div>', f"<li class=comment><p>{sentences(2)}</p></li>", f"<article class=comment><p>{sentences(2)}</p></article>"]) for _ in range(rng.randint(1, 5)))
        return named(rng.choice(["section", "div"]), ["comments", "discussion", "reader-comments", "replies"], f"<h2>{words(1, 2)}</h2>" + each + rng.choice(["", form()]), 0)

    def bottom():
        return named(rng.choice(["footer", "footer", "div"]), ["footer", "site-footer", "copyright"], rng.choice([f"&copy; {words(1, 3)}", f"&copy; {words(1, 2)} &middot; {words(3, 9)}.", f"<p>{sentences(1)}</p>", links(4) + f"<p>&copy; {words(1, 3)}</p>"]))

    def unnamed():
        return "<div>" + rng.choice([words(1, 3), " ".join(f"<a href=/{i}>{words(1, 2)}</a>" for i in range(rng.randint(2, 6))), links(rng.randint(2, 6)), f"&copy; {words(1, 3)}"]) + "</div>"

    out = []
    for _ in range(n):
        layout = rng.choice(layouts)
        before = [f() for f in (top, menu, notice, advert) if rng.random() < 0.55]
        after = [f() for f in (social, comments, side, advert, form) if rng.random() < 0.4]
        rng.shuffle(after)
        if layout == "plain" and rng.random() < 0.7:
            before, after = [unnamed() for _ in range(rng.randint(0, 2))], [unnamed() for _ in range(rng.randint(0, 2))]
        body = "".join(before) + article(layout) + "".join(after) + (bottom() if rng.random() < (0.4 if layout == "plain" else 0.85) else "")
        if rng.random() < 0.4:
            body = f'<div {rng.choice(["id=page", "class=wrapper", "class=site", "class=with-sidebar", ""])}>{body}</div>'
        out.append(body if rng.random() < 0.15 else f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body{rng.choice(['', '', ' class=has-sidebar'])}>{body}</body></html>")
    return out


@functools.cache
def trained() -> TreeModel:
    """The model of ``labelled_pages()``."""
    return fit(labelled_pages())


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, model: TreeModel | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row: the main text of the whole page.

    Blocks are the stretches of text between borders of block elements (a line break is white space), character references
    decoded, white space inside turned into one space; the content blocks are joined by one space. Null and empty pages, and
    pages without content, give an empty text; repeated rows are extracted each; null ids and addresses stay null; broken or
    cut-off markup is read as far as it goes; other columns are ignored. Row-local: no shuffle.
    """
    model = model or trained()
    sent = (model.unary, model.pair)

    def run(batches):
        local = TreeModel()
        local.unary, local.pair = sent
        for part in slices(batches):
            found = [local.text(x) for x in part.column("t").to_pylist()]
            yield made(OUT, part.column("k"), part.column("url"), found, [len(x) for x in found])

    given = pages.select(F.col(id_column).cast("bigint").alias("k"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("t"))
    return given.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


#: For the given pages only: their articles are marked as such, so SQL can cut them out without a model.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1) AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '<[^>]*\z', '') AS x FROM a),
u AS (SELECT page_id, url, replace(replace(replace(replace(x, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>') AS x FROM t),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
