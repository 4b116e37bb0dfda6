"""Quotes searched for in pages, against a plain search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vitrine.operators import evidence as E, search as S

KEYS = ["site"]
PAGES = "site string, place int, url string, visible_text string"


def plain(claims, pages):
    """``(site, quote, place)`` by looking at every page for every quote."""
    squashed = lambda t: " ".join(t.lower().split())
    found = {}
    for site, quote in claims:
        q = squashed(quote or "")
        held = [place for s, place, _, text in pages if q and site is not None and s == site and place is not None and text is not None and q in squashed(text)]
        if held:
            found[site, q] = min(held)
    return found


def found(spark, claims, pages, site="string"):
    c, p = spark.createDataFrame(claims, f"site {site}, quote string"), spark.createDataFrame(pages, PAGES)
    rows = E.quoted_on(c, p, KEYS).collect()
    assert len({(str(r.site), r.quote) for r in rows}) == len(rows) and all(r.url == f"u{r.place}" for r in rows)
    return {(r.site, r.quote): r.place for r in rows}


def test_common_words_do_not_bring_every_page_to_every_quote(spark, monkeypatch):
    kept, cut = [], E.cut
    monkeypatch.setattr(E, "cut", lambda rows: kept.append(rows) or cut(rows))
    # Every page has every pair of words that any quote has; only the order of the whole tells the pages apart.
    rng, words, pages, claims = random.Random(3), ["ab", "cd", "ef", "gh"], [], []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(400))
        pages.append(("s", i, f"u{i}", text))
        claims.append(("s", text[300:345]))
    assert found(spark, claims, pages) == plain(claims, pages)
    assert sum(rows.count() for rows in kept) <= 4 * len(claims)


def test_quotes_of_any_length_and_odd_rows(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("aé ß汉😀\n") for _ in range(n))
    pages = [(f"s{i % 3}", i, f"u{i}", text(rng.choice([0, 1, 5, 40, 300]))) for i in range(60)]
    pages += [("s1", 70, "u70", "x" * 9000 + " end"), (None, 71, "u71", "only here"), ("s1", None, "u72", "only there"), ("s1", 73, "u73", None)]
    # Two pages of one place, one of which has the quote.
    pages += [("s2", 80, "u80", "first of two"), ("s2", 80, "u80", "last of two")]
    claims = [("s1", "x" * 4096), ("s1", "x" * 5000 + "  "), ("s1", "X" * 9000 + " END"), ("s1", "x" * 9001), (None, "only here"), ("s1", "only here"), ("s1", "only there"), ("s2", "last of"), ("s2", "t of two"), ("s1", None), ("s1", " ")]
    for _ in range(400):
        held = rng.choice(pages[:60])[3]
        at = rng.randint(0, len(held))
        claims.append((f"s{rng.randint(0, 3)}", held[at : at + rng.randint(1, 40)]))
    want = plain(claims, pages)
    assert found(spark, claims, pages) == want and len(want) > 60


def test_what_passes_by_chance_is_no_result(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_BITS", 6)
    monkeypatch.setattr(S, "LEAST_BITS", 6)
    pages = [("s", i, f"u{i}", f"page {i} öf sixty, ändéd") for i in range(60)]
    claims = [("s", f"page {i}") for i in range(0, 90, 3)] + [("s", "é"), ("s", "zz")]
    assert found(spark, claims, pages) == plain(claims, pages)


def test_keys_of_other_types_meet_as_in_a_join(spark):
    pages = [(str(i % 2), i, f"u{i}", f"text number {i}") for i in range(6)]
    got = found(spark, [(0, "number 4"), (1, "number 4"), (1, "TEXT")], pages, "int")
    assert got == {(0, "number 4"): 4, (1, "text"): 1}


@pytest.mark.parametrize("piece", [1, 50, 1 << 18])
def test_occurrences_are_found_over_the_ends_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    monkeypatch.setattr(S, "PAIRS", 7)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 90]))).encode() for _ in range(60)]
    quotes = sorted({t[i : i + rng.randint(1, 20)] for t in texts for i in range(0, len(t), 9)})
    groups = lambda n: np.zeros(n, S.U)
    asked = np.concatenate(list(S._asked_by(*S._bytes(pa.array(quotes)), groups(len(quotes)))))
    slots = S._slots(asked, 20)
    bits = np.zeros(1 << 17, np.uint8)
    np.bitwise_or.at(bits, (slots >> S.U(3)).astype(np.int64), (1 << (slots & S.U(7)).astype(np.int64)).astype(np.uint8))
    lengths = np.unique([len(q) for q in quotes])
    sizes = {int(level): lengths[S._level(lengths) == level] for level in np.unique(S._level(lengths))}
    data, ends = S._bytes(pa.array(texts)[2:])
    got = [(int(r), int(b - ends[r]), int(n)) for rows in S._occurrences(data, ends, groups(len(texts) - 2), sizes, bits) for r, b, n in zip(*rows)]
    want = {(r, i, len(q)) for r, t in enumerate(texts[2:]) for q in quotes for i in range(len(t)) if t.startswith(q, i)}
    assert len(got) == len(set(got)) and want <= set(got) and len(got) < len(want) * 1.02
    cut = S._cut_out(data, *(np.array(x) for x in zip(*[(ends[r] + i, n) for r, i, n in got]))).to_pylist()
    assert cut == [texts[2:][r][i : i + n] for r, i, n in got]
