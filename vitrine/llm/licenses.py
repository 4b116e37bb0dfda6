"""Licence scans by canonical digests (operator 9): DataFrame expressions, and one Arrow step for texts that hold the first paragraph of a known text."""

from __future__ import annotations

import hashlib
import pkgutil
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .fixed_values import LICENSE_FILES, LICENSE_TEXTS, LICENSE_TITLES, SPELLINGS

#: A line that only says whose copyright it is, as the SQL has it.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright |\(c\)|©)[^\n]*"
#: The same for the scan: the word, mark or (c) before a year, mark or (c), or a line "Copyright <name>" that is a paragraph of its own.
_OWNED = (r"(?md)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*[:,]?[ \t]*(?:\(c\)|©|[\[<{(]?(?:\d{4}|yyyy|year)\b)|\(c\)[ \t]*(?:copyright\b|[\[<{(]?(?:\d{4}|yyyy|year)\b)|©)[^\n]*"
          r"|(?:(?<=\n[ \t]{0,9}\n)|\A)[^\p{L}\p{N}\n]*copyright (?!notice|holder|owner|law|license|licence|and |or |is |in |protect|infring)[^\n]{1,100}(?=\s*?\n[ \t]*\n|\s*\z)")
_PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Lower case, copyright lines out, spellings made equal, everything but letters, digits and line ends one space."""
    out = F.regexp_replace(F.lower(text), _OWNED, "")
    for pattern, new in SPELLINGS:
        out = F.regexp_replace(out, pattern, new) if pattern[0] == "[" else F.replace(out, F.lit(pattern), F.lit(new))
    return F.regexp_replace(out, _PUNCTUATION, " ")


def _one_line(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, r"[ \n]+", " "))


def whole_texts() -> list[tuple[str, str]]:
    """Known texts of more than one line: name, text. Lists of conditions stand with numbers and with bullets."""
    out = [(name, text) for name, text in LICENSE_TEXTS if "\n" in text]
    for name in LICENSE_FILES:
        text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
        out.append((name, text))
        if name.startswith("BSD"):
            numbers = iter(range(1, 9))
            out.append((name, re.sub(r"(?m)^ *\d\. ", "* ", text) if re.search(r"(?m)^ *\d\. ", text) else re.sub(r"(?m)^ *\* ", lambda _: f"{next(numbers)}. ", text)))
    return out


def known_texts() -> list[tuple[str, str]]:
    """Every known text, whole texts also below each of their usual titles."""
    whole = whole_texts()
    return [*LICENSE_TEXTS, *whole, *[(name, f"{title}\n{text}") for name, text in whole for title in LICENSE_TITLES.get(name, [])]]


def starts(spark: SparkSession) -> dict[str, tuple[int, list[int]]]:
    """Digest of the first paragraph of each whole text: the most blocks that the text may be cut into by empty lines, and the
    lengths of the known texts that begin with that paragraph, each as one canonical line."""
    rows = []
    for name, text in whole_texts():
        first = re.split(r"\n\s*\n", text.strip())[0] if re.search(r"\n\s*\n", text.strip()) else text.split("\n")[0]
        n = sum(1 for line in text.split("\n") if line.strip())
        rows += [(n, first), *[(n, f"{title}\n{first}") for title in LICENSE_TITLES.get(name, [])]]
    first = spark.createDataFrame(rows, "n int, text string").groupBy(_one_line(canonical(F.col("text"))).alias("f")).agg(F.max("n")).collect()
    texts = [r[0] for r in spark.createDataFrame([(text,) for _, text in known_texts()], "text string").select(_one_line(canonical(F.col("text")))).collect()]
    return {hashlib.md5(f.encode()).hexdigest(): (n, sorted({len(t) for t in texts if t.startswith(f)})) for f, n in first}


def known_digests(spark: SparkSession, texts=None) -> DataFrame:
    """``(license, digest)`` of the known texts, each digest once (the first name in order wins a tie)."""
    texts = known_texts() if texts is None else texts
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(texts)], "i int, license string, text string")
    digests = rows.select("i", "license", F.md5(_one_line(canonical(F.col("text")))).alias("digest"))
    return digests.groupBy("digest").agg(F.min_by("license", "i").alias("license"))


def _run_digests(first: dict[str, tuple[int, list[int]]]):
    """Digests of the runs of two and more neighbouring blocks, not the whole text, that begin with a known first paragraph and
    are as long as a known text. Every block's place is known by the length up to it, so a run's end is one lookup."""
    @F.pandas_udf("array<string>")
    def digests(texts: pd.Series) -> pd.Series:
        def of(blocks):
            found, begins, ends, at = [], [], {}, 0
            for j, block in enumerate(blocks):
                begins.append(at)
                at += len(block) + 1
                ends[at] = j + 1
            for i, block in enumerate(blocks):
                most, lengths = first.get(hashlib.md5(block.encode()).hexdigest(), (0, ()))
                for n in lengths:
                    j = ends.get(begins[i] + n + 1, 0)
                    if 2 <= j - i <= most and j - i < len(blocks):
                        found.append(hashlib.md5(" ".join(blocks[i:j]).encode()).hexdigest())
            return found

        return texts.map(of, na_action="ignore")

    return digests


def scan(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text",
         first: dict[str, tuple[int, list[int]]] | None = None) -> DataFrame:
    """``(doc_id, license, n_notices, notices)`` of every row.

    ``license`` names the known text that the whole text is (null if none). A document may also carry known texts inside: its
    lines, and its blocks of lines between empty lines, are entire texts looked up the same way; ``n_notices`` counts those
    found, ``notices`` their names, sorted and comma-joined (a block of one line is looked up as a line only, and the whole
    text is no block). Null, empty and punctuation-only texts match nothing; repeated rows are scanned each; a null id like
    any other; other columns are ignored. Runs of two and more neighbouring blocks, but not the whole text, are looked up from
    each block that is the first paragraph of a known whole text (``first``: see ``starts``), and only runs as long as a known
    text that begins so are put together, so that the work grows with a text's length however often a first paragraph stands
    in it. The known texts are joined by digest and may be a table of any size.
    """
    first = first if first is not None else starts(docs.sparkSession) if known is None else {}
    known = known if known is not None else known_digests(docs.sparkSession)
    text = F.col(text_column).cast("string")
    given = docs.select(F.col(id_column).cast("bigint").alias("k"), F.xxhash64(text).alias("h"), canonical(text).alias("c"))
    parts = F.split("c", r"\n[ \n]*\n")

    def unit(level, line):
        return F.struct(F.lit(level).alias("level"), F.when(line != "", F.md5(line)).alias("digest"))

    whole = F.array(unit(0, _one_line(F.col("c"))))
    lines = F.transform(F.split("c", "\n"), lambda x: unit(1, F.trim(x)))
    blocks = F.transform(F.filter(parts, lambda x: F.instr(F.trim(F.trim(F.trim(x), F.lit("\n"))), "\n") > 0), lambda x: unit(2, _one_line(x)))
    none = F.array().cast("array<struct<level:int,digest:string>>")
    units = [whole, lines, F.coalesce(blocks, none)]
    if first:
        paragraphs = F.filter(F.transform(parts, _one_line), lambda x: x != "")
        began = F.when(F.exists(paragraphs, lambda x: F.md5(x).isin(*first)), paragraphs)
        given = given.withColumn("runs", _run_digests(first)(began))
        units.append(F.coalesce(F.transform("runs", lambda d: F.struct(F.lit(3).alias("level"), d.alias("digest"))), none))
    # The number of blocks is asked for below the explode: beside it, it would be counted anew for every unit.
    units = given.withColumn("n_blocks", F.size(parts)).select("k", "h", "n_blocks", F.explode(F.concat(*units)).alias("u"))
    units = units.filter("u.digest is not null and (u.level < 2 or n_blocks > 1)").select("k", "h", "u.level", "u.digest")
    key = [F.coalesce(F.col("k").cast("string"), F.lit("null")).alias("key"), F.col("h")]
    # Rows with one id and one text hold the same units; each counts once.
    rows = given.groupBy("k", "h").agg(F.count("*").alias("_rows"))
    found = units.join(known, "digest").groupBy("k", "h").agg(
        F.max(F.when(F.col("level") == 0, F.col("license"))).alias("license"), F.count_if(F.col("level") > 0).alias("n"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("level") > 0, F.col("license")))), ",").alias("notices"))
    found = found.select(*key, "license", "n", "notices").join(rows.select(*key, "_rows"), ["key", "h"])
    plain = docs.select(F.col(id_column).cast("bigint").alias("k"), F.xxhash64(text).alias("h")).select("k", *key)
    return plain.join(found, ["key", "h"], "left").select(
        F.col("k").alias("doc_id"), "license", F.coalesce((F.col("n") / F.col("_rows")).cast("bigint"), F.lit(0).cast("bigint")).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    canon = f"regexp_replace(lower(text), {quoted(_COPYRIGHT)}, '', 'g')"
    for pattern, new in SPELLINGS:
        canon = f"regexp_replace({canon}, {quoted(pattern)}, {quoted(new)}, 'g')" if pattern[0] == "[" else f"replace({canon}, {quoted(pattern)}, {quoted(new)})"
    canon = f"regexp_replace({canon}, {quoted(_PUNCTUATION)}, ' ', 'g')"
    line = r"trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    values = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(LICENSE_TEXTS))
    return rf"""
WITH known AS (SELECT digest, arg_min(license, i) AS license FROM (SELECT i, license, md5({line.format(canon)}) AS digest FROM (VALUES {values}) v(i, license, text)) GROUP BY digest),
d AS (SELECT row_number() OVER () AS rid, doc_id, {canon} AS c FROM documents),
b AS (SELECT rid, unnest(regexp_split_to_array(c, '\n[ \n]*\n')) AS x, len(regexp_split_to_array(c, '\n[ \n]*\n')) AS n FROM d),
u AS (SELECT rid, 0 AS level, {line.format('c')} AS unit FROM d
      UNION ALL SELECT rid, 1, trim(unnest(string_split(c, chr(10)))) FROM d
      UNION ALL SELECT rid, 2, {line.format('x')} FROM b WHERE n > 1 AND contains(trim(trim(trim(x), chr(10))), chr(10))),
f AS (SELECT rid, max(license) FILTER (level = 0) AS license, count(*) FILTER (level > 0) AS n, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (level > 0) AS notices
      FROM u JOIN known ON md5(unit) = digest WHERE unit <> '' GROUP BY rid)
SELECT d.doc_id, f.license, coalesce(f.n, 0)::BIGINT AS n_notices, coalesce(f.notices, '') AS notices FROM d LEFT JOIN f USING (rid)
"""
