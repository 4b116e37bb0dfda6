"""Substring dedup over a compacted graph of word windows (operator 2).

Windows of ``k`` words are the edges of a de Bruijn graph. Neighbouring windows that agree on their leading run of words
form a *stretch*: a path without branches inside one document. Stretches, not windows, are shuffled: their keys meet in an
aggregate that finds the first document of each; where every occurrence of a key has the same words on both sides the path
is settled as a whole, and only where occurrences branch are single windows compared. Per document, settled stretches and
windows with one source join into spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import keyed, made, slices, stored, texts
from .words import U, Words, mixed, run_hashes

WINDOW = 13
#: Words of a leading run.
LEAD = 3
_BASE = U(0xA24BAED4963EE407)
#: Bytes of text whose words are arrays at a time: some fifty bytes of arrays for each.
ARRAY_BYTES = 1 << 20


def text_marks(words: Words) -> np.ndarray:
    """28 bits of each text's word sequence: they tell apart texts that share an id."""
    return run_hashes(words.hashes, words.first[:-1], words.first[1:], _BASE) >> U(36)


def stretches(words: Words, k: int = WINDOW, lead: int = LEAD):
    """Per stretch: text number, first window (as word number in the text), number of windows, key and content.

    A window's leading run is the ``lead`` words around its longest middle word, ties by hash, the first of equals; windows
    with equal words have equal leading runs, so equal passages fall into the same stretches except at their ends.
    """
    whole = words.whole(k)
    empty = np.zeros(0, np.int64)
    if not whole.any():
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    runs = words.windows(lead)
    length = np.minimum(words.end - words.start, 255).astype(np.uint64)[lead // 2:lead // 2 + len(runs)]
    order = ((U(255) - length) << U(56)) | (runs >> U(8))
    span = k - lead + 1
    n = len(whole)
    best = np.zeros(n, np.int64)
    least = order[:n].copy()
    for j in range(1, span):
        here = order[j:j + n]
        better = here < least
        least = np.where(better, here, least)
        best[better] = j
    at = best + np.arange(n)
    valid = np.flatnonzero(whole)
    new = np.ones(len(valid), bool)
    new[1:] = (at[valid[1:]] != at[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
    first = valid[new]
    size = np.diff(np.append(np.flatnonzero(new), len(valid)))
    content = mixed(run_hashes(words.hashes, first, first + size + k - 1, _BASE) + (at[first] - first).astype(np.uint64))
    doc = words.doc[first]
    return doc, first - words.first[doc], size, runs[at[first]], content


# ``at`` packs the text's mark (28 bits), the first window (31 bits) and the number of windows (4 bits).
def _packed(mark, pos, size):
    return ((mark.astype(np.int64) << 35) | (pos.astype(np.int64) << 4) | size).astype(np.int64)


def _rows(docs: DataFrame, k: int) -> DataFrame:
    """``(m, k, at, s)``: every stretch with its key and content."""
    schema = pa.schema([("m", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("s", pa.int64())])

    def run(batches):
        for part in slices(batches, limit=ARRAY_BYTES):
            w = Words(texts(part))
            doc, pos, size, key, content = stretches(w, k)
            ids = part.column("k").to_numpy(zero_copy_only=False)
            yield made(schema, pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(_packed(text_marks(w)[doc], pos, size)), pa.array(content.view(np.int64)))

    return docs.filter("k is not null").mapInArrow(run, "m bigint, k bigint, at bigint, s bigint")


def _windows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(h, g, k, at)``: hashes of 64 and 32 bits of every single window in the wanted stretches ``(k, at)``, from the texts they lie in."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("k", pa.int64()), ("at", pa.int64())])
    per_doc = wanted.groupBy("k").agg(F.collect_list("at").alias("ats"))

    def run(batches):
        for part in slices(batches, limit=ARRAY_BYTES):
            w = Words(texts(part))
            lists = part.column("ats")
            doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            at = lists.flatten().to_numpy()
            mark = text_marks(w).astype(np.int64)[doc]
            own = (at >> 35) & 0xFFFFFFF == mark
            doc, at = doc[own], at[own]
            size, pos = at & 15, (at >> 4) & 0x7FFFFFFF
            before = np.cumsum(np.append(0, size))
            each = np.repeat(np.arange(len(at)), size)
            step = np.arange(before[-1]) - before[each]
            first = w.first[doc[each]] + pos[each] + step
            h, g = w.windows(k)[first], (run_hashes(w.hashes, first, first + k, _BASE) >> U(32)).astype(np.uint32)
            ids = part.column("k").to_numpy()
            yield made(schema, pa.array(h.view(np.int64)), pa.array(g.view(np.int32)), pa.array(ids[doc[each]]), pa.array((at[each] & -16) + step * 16 + 1))

    return docs.join(per_doc, "k").mapInArrow(run, "h bigint, g int, k bigint, at bigint")


def repeated(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """``(k, at, source)``: stretches of document ``k`` all of whose windows start in the earlier document ``source`` too.

    ``docs`` has the columns ``k`` (id) and ``t`` (text). Hot keys are pre-aggregated before the shuffle, and joins back to the
    occurrences can be split by Spark. Texts are shuffled once for the windows of branching stretches.
    """
    keys = _rows(docs, k).groupBy("m").agg(F.min("k").alias("source"), F.max("k").alias("last"), (F.min("s") != F.max("s")).alias("branching"))
    keys = stored(keys.filter("source < last").drop("last"), "keys")
    met = stored(_rows(docs, k).select("m", "k", "at").join(keys, "m").filter("branching or k > source").drop("m"), "met")
    windows = stored(_windows(docs, met.filter("branching").select("k", "at"), k), "windows")
    sources = windows.groupBy("h", "g").agg(F.min("k").alias("source"), F.max("k").alias("last")).filter("source < last").drop("last")
    single = windows.join(sources, ["h", "g"]).filter("k > source").select("k", "at", "source")
    return met.filter("not branching").select("k", "at", "source").union(single)


def spans(found: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Compact ``(first window, windows, source)`` into maximal ``(first word, end, source)``: neighbours with one source join."""
    out: list[list[int]] = []
    for pos, n, source in sorted(found):
        if out and source == out[-1][2] and pos <= out[-1][1] - k + 1:
            out[-1][1] = max(out[-1][1], pos + n + k - 1)
        else:
            out.append([pos, pos + n + k - 1, source])
    return [tuple(x) for x in out]


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = WINDOW, with_text: bool = True,
          carry: list[str] | None = None) -> DataFrame:
    """Per row ``(doc_id, n_words, n_removed, n_spans, kept, kept_sha256)``: the words outside repeated windows.

    A word goes when a window of ``k`` words over it also starts in a document with a smaller id; windows are judged on the
    input. ``kept`` is the words left, joined by one space (null unless ``with_text``), ``n_spans`` the repeated spans after
    compaction. Content is compared by hashes of the words at its place: key and content of 64 bits each, or 96 bits of a single window. Null
    and empty texts have no words; rows with one id are one document and never judge each other; rows with a null id keep all
    words and are no source; no rows give no rows; other columns are ignored, but those named in ``carry`` come along as the
    struct ``row``.
    """
    given = keyed(docs, id_column, text_column)
    rows = docs.select(F.col(id_column).cast("bigint").alias("k"), F.col(text_column).cast("string").alias("t"), F.struct(*carry).alias("row")) if carry else given
    per_doc = repeated(given, k).groupBy("k").agg(F.collect_list(F.struct("at", "source")).alias("found"))

    def run(batches):
        for part in slices(batches, limit=ARRAY_BYTES):
            all_texts, counts, removed, n_spans, kept = texts(part), [], [], [], []
            marked = text_marks(Words(all_texts)).tolist()
            for t, mark, found in zip(all_texts, marked, part.column("found").to_pylist()):
                words = t.encode().split()
                joined = spans([((x["at"] >> 4) & 0x7FFFFFFF, x["at"] & 15, x["source"]) for x in found or [] if (x["at"] >> 35) & 0xFFFFFFF == mark], k)
                gone = np.zeros(len(words), bool)
                for a, b, _ in joined:
                    gone[a:b] = True
                counts.append(len(words))
                removed.append(int(gone.sum()))
                n_spans.append(len(joined))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if joined else b" ".join(words))
            row = [("row", part.column("row").type)] if carry else []
            yield made(pa.schema(_OUT + row), part.column("k"), counts, removed, n_spans, [x.decode() for x in kept] if with_text else [None] * len(kept),
                       [hashlib.sha256(x).hexdigest() for x in kept], *([part.column("row")] if carry else []))

    kinds = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept string, kept_sha256 string"
    return rows.join(per_doc, "k", "left").mapInArrow(run, kinds + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns; where words went, the text is what is left, joined by one space."""
    found = dedup(docs, id_column, text_column, k, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.{text_column}"))
    return found.select(*[text.alias(c) if c == text_column else F.col(f"row.{c}").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
g AS (SELECT rid, doc_id, p, array_to_string(w[p:p + 12], ' ') AS t FROM p),
f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t),
r AS (SELECT DISTINCT rid, unnest(range(p, p + 13)) AS q FROM g JOIN f USING (t) WHERE first < doc_id),
v AS (SELECT rid, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS kept FROM v ANTI JOIN r USING (rid, q) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
