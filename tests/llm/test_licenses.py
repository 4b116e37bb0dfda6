"""Licence scans of texts as they stand in files: wrapped, titled, with blank lines, inside longer documents."""

import hashlib
import textwrap
import time

import pytest
from pyspark.sql import functions as F
from vitrine.llm import licenses
from vitrine.llm.fixed_values import LICENSE_TEXTS


def scanned(spark, texts):
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    return [tuple(r)[1:] for r in sorted(found)]


def test_wrapped_texts_keep_lines_that_begin_with_copyright(spark):
    names, texts = [], []
    for name, text in LICENSE_TEXTS[:4]:
        for width in (*range(40, 100, 3), 71, 72):
            names.append(name)
            texts.append("Copyright (c) 2020, A. Name\n\n" + "\n".join(textwrap.fill(x, width) for x in text.split("\n")))
    assert any("\ncopyright notice" in t for t in texts)
    assert [r[0] for r in scanned(spark, texts)] == names
    isc = LICENSE_TEXTS[1][1]
    for line in ("Copyright A. Name", "© A. Name", "Copyright 2020 A. Name", "(c) 2020 A. Name", "Copyright [yyyy] [name]"):
        assert scanned(spark, [f"{line}\n\n{isc}"])[0][0] == "ISC"


def test_whole_texts_with_titles_and_blank_lines(spark):
    mit = LICENSE_TEXTS[0][1].replace("\n", "\n\n")
    whole = licenses.whole_texts()
    got = scanned(spark, [f"MIT License\n\nCopyright (c) 2020 A. Name\n\n{mit}", f"Some words before.\n\n{mit}\n\nSome words after.", *[t for _, t in whole], *[f"before\n\n{t}\n\nafter" for _, t in whole[3:]]])
    assert got[0][0] == "MIT" and got[1] == (None, 1, "MIT")
    assert [r[0] for r in got[2:2 + len(whole)]] == [n for n, _ in whole]
    assert all(n in notices.split(",") for (n, _), (_, _, notices) in zip(whole[3:], got[2 + len(whole):]))
    assert {"BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense"} <= {n for n, _ in whole}


def test_repeated_first_paragraphs_cost_their_length(spark):
    heading = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n"
    gpl = dict(licenses.whole_texts())["GPL-3.0"]
    # Runs of every length that a known text has begin at each heading; the last heading begins the text itself.
    texts = [heading * 2000, heading * 300 + gpl + "\n\nafter", (heading + "some words\n\n") * 60_000]
    started = time.monotonic()
    got = scanned(spark, texts)
    assert time.monotonic() - started < 90
    assert [r[0] for r in got] == [None, None, None]
    assert got[0][1:] == (0, "") and "GPL-3.0" in got[1][2].split(",") and got[2][1:] == (0, "")


def test_only_runs_as_long_as_a_known_text_can_match(spark):
    """Lengths of ``starts`` against every run of blocks put together, as one would do by hand."""
    known = {r["digest"]: r["license"] for r in licenses.known_digests(spark).collect()}
    first = licenses.starts(spark)
    mit = LICENSE_TEXTS[0][1].replace("\n", "\n\n")
    whole = dict(licenses.whole_texts())
    texts = [f"a\n\n{mit}\n\n{mit}\n\nb", f"{whole['BSD-3-Clause']}\n\n{whole['ISC']}\n\nc", f"x\n\n{whole['Unlicense']}\n\n{whole['Zlib']}", f"MIT License\n\n{mit}\n\nend"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    cut = frame.select("doc_id", F.filter(F.transform(F.split(licenses.canonical(F.col("text")), r"\n[ \n]*\n"), licenses._one_line), lambda x: x != "").alias("p"))
    want = {}
    for doc_id, p in cut.collect():
        digests = [hashlib.md5(" ".join(p[i:j]).encode()).hexdigest() for i in range(len(p)) if hashlib.md5(p[i].encode()).hexdigest() in first
                   for j in range(i + 2, len(p) + 1) if j - i < len(p)]
        want[doc_id] = {known[d] for d in digests if d in known}
    got = {r["doc_id"]: set(r["notices"].split(",")) - {""} for r in licenses.scan(frame).collect()}
    assert all(want[i] and want[i] <= got[i] for i in want)
