"""Tags that are easily taken for raw elements, stray quotes, small pages of common layouts, deep nesting, layouts left out of training."""

import time

import pytest

from vitrine.llm.html_text import LAYOUTS, Page, fit, labelled_pages, trained


def said(source):
    return " ".join(t for _, t in Page(source).blocks)


def test_custom_and_self_closing_elements_are_not_raw():
    for tag in ("<svg-icon></svg-icon>", "<select-box></select-box>", "<title-block></title-block>", "<object-view/>", "<template-x></template-x>", "<svg class='a'/>", "<svg/>", "<math/>", "<svg><path d='x'/><text>no</text></svg>"):
        assert said(f"<article><h1>T</h1>{tag}<p>Body one.</p></article>") == "T Body one.", tag


def test_math_in_sentences_is_text():
    assert said("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x = 2</annotation></math> hold.</p>") == "Let x=2 hold."


def test_a_stray_quote_ends_with_its_tag():
    assert said("<p title='don't'>It was there. It's gone.</p><p>More > less.</p>") == "It was there. It's gone. More > less."
    assert said('<p title="a > b" data-x=\'c > d\'>Kept.</p>') == "Kept."


LONG = "The river rose slowly during the night and nobody in the town had expected it."
SMALL = {
    "contents, pull quote and footer in an article": (
        f"<article><ul class='toc'><li><a href='#a'>One</a></li><li><a href='#b'>Two</a></li></ul><h2>Flood</h2><p>{LONG}</p><blockquote class='pullquote'>Nobody knew.</blockquote><footer>Written by Ann.</footer></article>",
        f"Flood {LONG} Nobody knew."),
    "contents as a menu": (f"<article><nav class='toc'><ul><li><a href='#a'>One</a></li><li><a href='#b'>Two</a></li></ul></nav><h2>Flood</h2><p>{LONG} {LONG}</p><footer>Written by Ann.</footer></article>", f"Flood {LONG} {LONG}"),
    "plain divs with paragraphs": (f"<div>Site name</div><div><a href=/>Home</a> <a href=/b>News</a></div><div><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p></div><div>&copy; 2020</div>", f"{LONG} {LONG} {LONG} {LONG}"),
    "plain divs with text": (f"<div><div>{LONG} {LONG}</div><div>{LONG} {LONG}</div></div>", f"{LONG} {LONG} {LONG} {LONG}"),
    "short article before a dialog": ("<article><p>It rained.</p></article><dialog class='cookie'><p>We use cookies.</p><button>OK</button></dialog>", "It rained."),
    "short article after a notice": ("<div role=dialog class='cookie-banner'><p>We use cookies to make this site better for you.</p><button>OK</button></div><article><p>It rained.</p></article>", "It rained."),
    "related article": (f"<main><article><h1>Flood</h1><p>{LONG} {LONG}</p><p>{LONG}</p></article><article><h3>Other</h3><p>Read about the dry summer.</p></article></main>", f"Flood {LONG} {LONG} {LONG}"),
    "advert in the article": (f"<article><h1>Flood</h1><p>{LONG} {LONG}</p><div class='ad-slot'><p>Buy our new boots now, they are good.</p></div><p>{LONG}</p></article>", f"Flood {LONG} {LONG} {LONG}"),
    "table under a heading": ("<main><h1>Prices</h1><table><tr><th>Item</th><th>Cost</th></tr><tr><td>Boots</td><td>12</td></tr></table></main>", "Prices Item Cost Boots 12"),
    "no wrapper": (f"<h1>Flood</h1><p>{LONG} {LONG}</p><p>{LONG}</p>", f"Flood {LONG} {LONG} {LONG}"),
}


@pytest.mark.parametrize("name", SMALL)
def test_small_pages(name):
    inner, text = SMALL[name]
    assert trained().text(f"<html><body>{inner}</body></html>") == text


def test_end_tags_of_headings_end_any_heading():
    page = Page("<h3>One</h2><p>Two</p>")
    assert [page.tags[page.parents[node]] for node, _ in page.blocks] == ["html", "html"]


def test_time_of_nested_and_unmatched_elements_is_linear():
    n = 100_000
    for source in ("<div>" * n + "x" + "</div>" * n, "<div>" * n + "x" + "</section>" * n, ("<div>" * n + "</p></i>" * n), "<p>a</div>" * n):
        start = time.perf_counter()
        Page(source).features()
        assert time.perf_counter() - start < 10  # seconds; the square of this length takes many minutes


@pytest.mark.parametrize("left_out", LAYOUTS)
def test_layouts_left_out_of_training(left_out):
    model, wrong, blocks = fit(labelled_pages(120, layouts=tuple(x for x in LAYOUTS if x != left_out))), 0, 0
    for source in labelled_pages(40, seed=99, layouts=(left_out,)):
        page = Page(source)
        likely, _ = model.marginals(page)
        for node, _ in page.blocks:
            blocks += 1
            wrong += (likely[node] > 0.5) != ("data-main" in page.attributes[node])
    assert wrong / blocks < 0.15  # an unseen layout: at most 0.125 were measured, for pages without any wrapper; below 0.01 for most
