"""Rounding, NULL-safe arithmetic and text normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def rounded(value: Column, places: int = 0) -> Column:
    """Half-even rounding on the double, the way scores are rounded everywhere in this package."""
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def whole(value: Column) -> Column:
    return F.rint(value).cast("bigint")


def ratio(part: Column, total: Column) -> Column:
    """NULL, never 0, when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), total.cast("double"))


def between(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1)


def n_words(text: Column) -> Column:
    """Counted without ``split``, which compiles its pattern again for every value."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def line_words(line: Column) -> Column:
    """``n_words`` of a page line: lines hold no white space but plain spaces, so the cheap class is exact.

    Where single spaces stand between the words they are counted by the bytes that go with them.
    """
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    odd = line.rlike(r"[\t\n\x0B\f\r]| (?= |$)|^(?: |$)")
    return F.when(odd, F.regexp_count(line, F.lit(r"\S+"))).otherwise(spaces + 1)


def has_words(line: Column, n: int) -> Column:
    """``line_words(line) >= n`` from the line's first ``n`` words alone."""
    return line.rlike(rf"^\s*+(?:\S++\s++){{{n - 1}}}\S")


def clean(text: Column) -> Column:
    """Runs of whitespace become one space."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clip(text: Column, limit: int) -> Column:
    flat = clean(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…")))


def squash(text: Column) -> Column:
    return F.lower(clean(text))


def squeeze(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def digits(phone: Column) -> Column:
    """Last ten digits; empty when there are too few to be a phone number."""
    only = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(F.length(only) >= 7, F.right(only, F.lit(10))).otherwise(F.lit(""))


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def literal(term: Column) -> Column:
    """A regex that matches the term's characters as they are."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(text: Column, term: Column, letters: str = r"\w", flags: str = "(?iU)") -> Column:
    """Whether the term occurs in the text with no character of ``letters`` touching it."""
    pattern = F.concat(F.lit(f"{flags}(?<!{letters})"), literal(term), F.lit(f"(?!{letters})"))
    return F.regexp_like(text, pattern)


def present(items: list[Column]) -> Column:
    """The given values as an array without the NULL ones, in order."""
    return F.array_compact(F.array(*items))


def first_where(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first true condition."""
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(default))


def lookup(value: Column, table: dict, default=None) -> Column:
    """A fixed dictionary as a map literal: no join, nothing to broadcast."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), value)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def titlecase_split(word: Column) -> Column:
    """``LegalService`` becomes ``Legal Service``."""
    return F.regexp_replace(word, "(?<=[a-z])(?=[A-Z])", " ")
