"""Token counts with overlap resynchronisation (operator 6)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import keyed, made, slices, texts
from .memo import library, spaced_words

#: Texts of more characters are encoded in overlapping chunks.
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 256
TOKEN_LIMIT = 512

#: A place between a visible character and a single space before a visible character. Every pattern of the byte-level kind
#: ends a token there whatever stands further away, and no added string holds a space.
_STABLE = re.compile(r"(?<=\S) (?=\S)")


def spliced(encode, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of ``text`` from overlapping chunks. ``encode(text)`` gives ``(ids, starts)``, starts in characters.

    Two neighbours are joined at a place in their overlap where both start a token and which is stable. Without one the
    overlap is doubled, and when it would reach the start of what is known the chunk itself is encoded longer; a text without
    any stable place ends as one chunk.
    """
    n, start, end = len(text), 0, min(len(text), chunk)
    ids, starts = encode(text[start:end])
    known, out, width = 0, [], overlap
    while end < n:
        after = end - width
        if after <= known:  # nothing in common yet: a longer chunk from the last join
            start, end = known, min(n, max(end + chunk, known + 2 * (end - known)))
            ids, starts = encode(text[start:end])
            width = overlap
            continue
        stop = min(n, max(after + chunk, end + 1))
        new_ids, new_starts = encode(text[after:stop])
        mine = np.asarray(starts) + start
        common = np.intersect1d(mine[mine > after], np.asarray(new_starts) + after)
        # The last token of a chunk may have been cut, so a join needs text of the older chunk behind it.
        at = next((int(p) for p in common if p < end - 1 and _STABLE.match(text, int(p))), None)
        if at is None:
            width *= 2
            continue
        out += [i for i, s in zip(ids, mine) if known <= s < at]
        known, start, end, ids, starts, width = at, after, stop, new_ids, new_starts, overlap
    mine = np.asarray(starts, dtype=np.int64) + start
    return out + [i for i, s in zip(ids, mine) if s >= known]


def _with_starts(tok):
    def encode(text: str):
        e = tok.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets]
    return encode


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = TOKEN_LIMIT,
                 chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row, as the tokenizer file's library counts the whole text.

    Texts over ``chunk`` characters are encoded in overlapping chunks and spliced; others are counted word by word from a
    bounded table of remembered words, or by the library where the file's kind has no safe word boundary. ``tokenizer`` is a
    file every worker can open. Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; a null id
    stays null; other columns are ignored.
    """
    def run(batches):
        lib, words = library(tokenizer), spaced_words(tokenizer)
        long = _with_starts(lib.tok)
        for part in slices(batches):
            all_texts = texts(part)
            counts = words.count([t if len(t) <= chunk else "" for t in all_texts])
            for i, t in enumerate(all_texts):
                if len(t) > chunk:
                    counts[i] = len(spliced(long, t, chunk, overlap) if lib.spaced else lib.ids(t))
            size = [len(t.encode()) for t in all_texts]
            yield made(SCHEMA, part.column("k"), size, counts, [c > limit for c in counts])

    return keyed(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
