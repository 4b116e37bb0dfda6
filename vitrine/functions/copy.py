"""Signals of page copy as row-local column expressions over a text and its lines."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from . import fixed_values as fixed
from .scalars import SPACE, between, first_where, has_words, let, literal, line_words, ratio, strip, whole

FLAGS = "(?iU)"


def phrase_pattern(phrases: list[str]) -> str:
    """Whole phrases, any whitespace between their words. Grouped by first letter, so few branches are tried per word."""
    def escaped(text: str) -> str:
        return "".join(r"\s+" if c == " " else c if c.isalnum() or not c.isascii() else "\\" + c for c in text)

    groups: dict[str, list[str]] = {}
    for phrase in phrases:
        groups.setdefault(phrase[0], []).append(escaped(phrase[1:]))
    branches = [f"{escaped(first)}(?:{'|'.join(rest)})" for first, rest in groups.items()]
    return rf"{FLAGS}(?<!\w)(?:{'|'.join(branches)})(?!\w)"


#: The characters that matches of a pattern start with; asking for them first is cheaper than a word boundary.
STARTS = {"we": "wWoOuU", "you": "yY", "number": r"0-9$£€\x{80}-\x{10ffff}", "stat": r"0-9\x{80}-\x{10ffff}"}


def pattern(name: str) -> str:
    return (f"(?=[{STARTS[name]}])" if name in STARTS else "") + FLAGS + fixed.PATTERNS[name]


def _loose(stated: str) -> str:
    """What every match of a pattern holds, for the linear-time engine of Arrow: no word boundaries, and white space and digits by
    their Unicode classes. Letters that match an ASCII letter only under Java's folding ask for the pattern by themselves."""
    plain = stated.replace(r"\b", "").replace(r"\s", r"[\t-\r\x{85}\pZ]").replace(r"\d", r"\p{Nd}")
    return f"(?i:{plain})|[\u0130\u0131\u017f\u212a]"


def _loose_phrases(phrases: list[str]) -> str:
    return _loose("|".join(re.escape(p).replace("\\ ", r"\s+") for p in phrases))


def _asked() -> dict[str, str]:
    found = {name: _loose_phrases(phrases) for name, phrases in (
        ("stock", fixed.STOCK), ("openers", fixed.OPENERS), ("puffery", fixed.PUFFERY), ("balance", fixed.BALANCE))}
    return found | {name: _loose(fixed.PATTERNS[name]) for name in (
        "contrast", "split_contrast", "no_just", "triad", "stat", "pressure", "fomo", "loss_aversion", "authority", "template")}


#: Pattern by pattern, what a text must hold for the pattern to match in it at all; a pattern's place is its bit in ``asks``.
ASKED = _asked()


@F.arrow_udf(T.LongType())
def asks(body: pa.Array, visible: pa.Array) -> pa.Array:
    """Bits of the patterns of ``ASKED`` that can match, the template's in the visible text, all others in the body."""
    bits = pa.scalar(0, pa.int64())
    for at, (name, loose) in enumerate(ASKED.items()):
        held = pc.fill_null(pc.match_substring_regex(visible if name == "template" else body, loose), False)
        bits = pc.bit_wise_or(bits, pc.if_else(held, pa.scalar(1 << at, pa.int64()), pa.scalar(0, pa.int64())))
    return bits


def asked(bits: Column, name: str) -> Column:
    return F.bit_get(bits, F.lit(list(ASKED).index(name))) == 1


def hits(bits: Column, name: str, found: Column) -> Column:
    """``found``, the matches of one pattern, without a search where it cannot match."""
    return F.when(asked(bits, name), found).otherwise(0)


def count(text: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in patterns])


def english_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z][A-Za-z'’-]*"))


def opening(line: Column) -> Column:
    """The first three words of a line."""
    words = F.regexp_extract(F.lower(line), "^[^a-z']*([a-z']+(?:[^a-z']+[a-z']+){0,2})", 1)
    return F.regexp_replace(words, "[^a-z']+", " ")


def openings(lines: Column) -> Column:
    found = F.transform(F.filter(lines, lambda x: has_words(x, 2)), opening)
    return F.filter(F.array_distinct(found), lambda o: o != "")


def sentences(lines: Column) -> Column:
    """Sentences of three words or more from lines of six words or more."""
    prose = F.array_join(F.filter(lines, lambda x: has_words(x, 6)), "\n")
    return F.filter(F.split(prose, r"(?<=[.!?])\s+|\n"), lambda s: has_words(s, 3))


def rate(hits: Column, words: Column) -> Column:
    return hits / words * F.lit(1000.0)


def rated(hits: Column, words: Column, cap: int) -> Column:
    """0-100: the rate per 1,000 words against the rate that scores 100."""
    return whole(F.least(rate(hits, words) / F.lit(float(cap)), F.lit(1.0)) * 100)


def sentence_sums(found: Column) -> Column:
    """Number, sum and sum of squares of the words in sentences."""
    lengths = F.transform(found, lambda s: line_words(s).cast("double"))
    return F.aggregate(lengths, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                       lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))


def variation(sums: Column) -> Column:
    """Coefficient of variation of sentence lengths."""
    return F.sqrt(sums["n"] * sums["q"] - sums["s"] * sums["s"]) / sums["s"]


def rhythm(found: Column) -> Column:
    """Sentence-length uniformity from the coefficient of variation; 0 under eight sentences."""
    return let(sentence_sums(found), lambda a: F.when(a["n"] < 8, F.lit(0).cast("bigint")).otherwise(
        whole(between((F.lit(0.6) - variation(a)) / 0.35, 0.0, 1.0) * 100)))


def rhythm_facts(lines: Column) -> Column:
    """``(count, cv, mean_words)`` of the sentences; the last two NULL under eight."""
    return let(sentence_sums(sentences(lines)), lambda a: F.struct(
        a["n"].cast("bigint").alias("count"), F.when(a["n"] >= 8, F.bround(variation(a), 2)).alias("cv"), F.when(a["n"] >= 8, F.bround(a["s"] / a["n"], 1)).alias("mean_words")))


def skeleton_hits(lines: Column, common: Column) -> Column:
    """Lines of two words or more whose opening is among the hashes ``common``."""
    return F.size(F.filter(lines, lambda x: has_words(x, 2) & F.array_contains(common, F.xxhash64(opening(x)))))


def self_focus(text: Column, we: Column, you: Column, first: Column, brand: Column | None) -> Column:
    """Share of we-words against you-words, more when the first sentence opens on the company."""
    opens = F.coalesce(first.rlike(r"(?iU)^(?:we|our)\b"), F.lit(False))
    if brand is not None:
        named = F.coalesce(brand, F.lit(""))
        we = we + F.when(named != "", F.regexp_count(text, F.concat(F.lit(r"(?iU)\b"), literal(named), F.lit(r"\b")))).otherwise(0)
        opens = opens | F.coalesce((named != "") & F.startswith(F.lower(first), F.lower(named)), F.lit(False))
    def score(n: Column) -> Column:
        share = F.coalesce(ratio(n["we"], n["we"] + n["you"]), F.lit(0.5))
        base = whole(between((share - 0.4) / 0.4, 0.0, 1.0) * F.least(F.lit(1.0), (n["we"] + n["you"]) / 5) * 100)
        return F.least(F.lit(100).cast("bigint"), base + F.when(n["opens"], 20).otherwise(0))

    return let(F.struct(we.alias("we"), you.alias("you"), opens.alias("opens")), score)


def unsupported_claims(text: Column, brand: Column | None, bits: Column | None = None) -> Column:
    """Boasts outside the company's own name, and statistics whose sentence names no source or measurement."""
    named = text
    if brand is not None:
        named = F.when(F.coalesce(brand, F.lit("")) != "", F.regexp_replace(text, F.concat(F.lit(FLAGS), literal(brand)), F.lit("brand"))).otherwise(text)
    boasts = count(named, phrase_pattern(fixed.PUFFERY))
    # Few sentences hold a statistic at all, so that is asked first.
    bare = F.filter(F.split(text, r"[!?\n]|\.(?= )"),
                    lambda s: s.rlike(pattern("stat")) & ~s.rlike(pattern("sourced")) & ~s.rlike(pattern("measured")))
    stats = F.aggregate(bare, F.lit(0), lambda total, s: total + count(s, pattern("stat")))
    # No statistic reaches over the end of a sentence, and no boast holds the word that stands for the brand.
    return boasts + stats if bits is None else hits(bits, "puffery", boasts) + hits(bits, "stat", stats)


def one_sidedness(markers: Column, words: Column) -> Column:
    return F.when(words < 300, 0).otherwise(F.greatest(F.lit(0), F.lit(100) - markers * 50)).cast("bigint")


def weighted(signals: dict[str, Column], weights: dict[str, tuple]) -> Column:
    return reduce(lambda a, b: a + b, [signals[name] * F.lit(float(w)) / 100 for name, (w, _) in weights.items()])


def level(score: Column) -> Column:
    return first_where([(score.isNull(), "UNKNOWN"), (score >= 60, "HIGH"), (score >= 30, "MEDIUM")], "LOW")


def top_signals(signals: dict[str, Column], n: int = 3) -> Column:
    """Names of the highest non-zero signals, ties in declared order."""
    scored = F.array(*[F.struct((-score).alias("score"), F.lit(at).alias("at"), F.lit(name).alias("name"))
                       for at, (name, score) in enumerate(signals.items())])
    kept = F.slice(F.array_sort(F.filter(scored, lambda s: s["score"] < 0)), 1, n)
    return F.transform(kept, lambda s: s["name"])


def snippets(text: Column, regex: str, limit: int = 5, around: int = 40) -> Column:
    """Text around the first matches. Offsets come from the lengths of the matches and of the text between them."""
    found = F.regexp_extract_all(text, F.lit(f"({regex})"), 1)
    gaps = F.split(text, regex, -1)

    def context(i: Column) -> Column:
        gap_sum = F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g))
        start = gap_sum + F.aggregate(F.slice(found, F.lit(1), i - 1), F.lit(0), lambda a, m: a + F.length(m))
        end = start + F.length(F.element_at(found, i))
        low, high = F.greatest(F.lit(0), start - around), F.least(F.length(text), end + around)
        body = strip(F.regexp_replace(F.substr(text, low + 1, high - low), SPACE, " "))
        return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(text), "…").otherwise(""))

    n = F.least(F.size(found), F.lit(limit))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), context)).otherwise(F.array().cast("array<string>"))
