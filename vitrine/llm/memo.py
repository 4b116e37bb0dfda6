"""Tokens of words, remembered per Python worker.

Encoding a text costs about a microsecond per byte, looking a word up a tenth of that. A tokenizer splits a text at places
that do not depend on what stands further away; between two such places a *unit* always gives the same ids. Units are
encoded once per worker and remembered; those that are new in a slice of text are encoded together. The memory is bounded in
bytes: units that were not met for a while are forgotten, which changes no result.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Bytes of units that a worker remembers, and what an entry takes besides its key and value.
TABLE_BYTES, ENTRY_BYTES = 160 << 20, 200
#: Letters whose lower case and normal form are one code point each, so that a word of them is one pre-token.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The letter of a space in byte-level vocabularies.
SPACE = "Ġ"
#: ASCII signs; not the apostrophe, which takes letters with it.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_LATIN_WORD = re.compile(f"[{LATIN}]+")


def parts_of(word: str) -> tuple[str, str] | None:
    """The letters and the signs behind them, each of them one pre-token or empty; None for a word of another form."""
    letters = word.rstrip(SIGNS)
    if not letters or letters.isalpha() and (letters.isascii() or _LATIN_WORD.fullmatch(letters)):
        return letters, word[len(letters):]
    return None


class Memo:
    """unit -> value, filled by ``encode`` with the units of a slice that are new.

    Two generations: what is met moves to the young one; when that holds half of ``limit`` bytes it becomes the old one, and
    what was old and never met again is gone.
    """

    def __init__(self, encode, limit: int = TABLE_BYTES):
        self.encode, self.limit, self.size = encode, limit, 0
        self.young, self.old = {}, {}

    def values(self, units: list[list]) -> list[list]:
        """The values of lists of units. ``encode`` turns a list of units into the list of their values."""
        if self.size > self.limit // 2:
            self.old, self.young, self.size = self.young, {}, 0
        young, old = self.young, self.old
        out = [list(map(young.get, us)) for us in units]
        gaps = [(us, vs, [i for i, v in enumerate(vs) if v is None]) for us, vs in zip(units, out) if None in vs]
        missing = {us[i] for us, _, at in gaps for i in at}
        new = [u for u in missing if u not in old]
        for found in ((u, old[u]) for u in missing if u in old), zip(new, self.encode(new) if new else []):
            for unit, value in found:
                young[unit] = value
                self.size += ENTRY_BYTES + len(unit) + (len(value) if isinstance(value, bytes) else 0)
        for us, vs, at in gaps:
            for i in at:
                vs[i] = young[us[i]]
        return out


#: The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


class Merges:
    """Pair merging of many short words at once: a word is a row of a matrix, and a round merges one pair in every row."""

    #: Bytes of the longest word that is merged here, and words of a matrix.
    LONGEST, ROWS = 24, 4096
    _NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges)]
        a, b, c = np.array(pairs, np.int64).reshape(-1, 3).T
        self.first = np.array([vocab[LETTER[x]] for x in range(256)], np.int32)
        self.last = np.array([vocab[LETTER[x] + suffix] for x in range(256)], np.int32)
        self.size = max(vocab.values()) + 2
        key = a * self.size + b
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), c[order].astype(np.int32)
        self.by_rank = c.astype(np.int32)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of every pair, ``_NONE`` of those that never merge; a number below 0 is no token."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], self._NONE)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of words of 1 to ``LONGEST`` bytes."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of one length make narrow matrices
        out = [b""] * len(words)
        for i in range(0, len(words), self.ROWS):
            some = order[i:i + self.ROWS]
            for j, x in zip(some, self._some([words[j] for j in some])):
                out[j] = x
        return out

    def _some(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        column, row = np.arange(size.max(initial=1)), np.arange(len(words))
        token = np.full((len(words), len(column)), -1, np.int32)
        raw = np.frombuffer(b"".join(words), np.uint8)
        token[column[None, :] < size[:, None]] = self.first[raw]
        token[row, size - 1] = self.last[raw[np.cumsum(size) - 1]]
        seen, back = np.unique(token[:, :-1].astype(np.int64) * self.size + token[:, 1:], return_inverse=True)
        rank = self._ranks(seen // self.size, seen % self.size)[back.reshape(len(words), -1)].astype(np.int32) if len(column) > 1 else np.zeros((len(words), 0), np.int32)
        done = np.full_like(token, -1)
        while len(row) and rank.shape[1]:
            at = rank.argmin(axis=1)  # the first of equal ones
            best = rank[np.arange(len(row)), at]
            go = best != self._NONE
            done[row[~go], :token.shape[1]] = token[~go]
            row, token, rank, at, best = row[go], token[go], rank[go], at[go], best[go]
            if not len(row):
                break
            i, right = np.arange(len(row)), column[None, :token.shape[1]] > at[:, None]
            token[i, at] = self.by_rank[best]
            token[:, :-1] = np.where(right[:, :-1], token[:, 1:], token[:, :-1])
            token[:, -1] = -1
            rank[:, :-1] = np.where(right[:, :rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = self._NONE
            after = np.minimum(at + 1, token.shape[1] - 1)
            rank[i, np.minimum(at, rank.shape[1] - 1)] = np.where(after > at, self._ranks(token[i, at], token[i, after]), self._NONE)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._ranks(token[before, at[before] - 1], token[before, at[before]])
            # One column fewer is needed when every row has merged.
            token, rank = token[:, :-1] if (token[:, -1] < 0).all() else token, rank[:, :-1] if (rank[:, -1] == self._NONE).all() and (token[:, -1] < 0).all() else rank
        done[row, :token.shape[1]] = token
        n = (done >= 0).sum(axis=1)
        flat, ends = done[done >= 0].astype("<u4").tobytes(), [0, *(np.cumsum(n) * 4).tolist()]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


class Library:
    """A tokenizer file with its added strings and, where its kind allows it, the rule that splits texts into units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.merges = lambda: Merges(model["vocab"], model["merges"], self.suffix)
        plain = model.get("type") == "BPE" and not model.get("dropout") and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or " " in x["content"] for x in spec.get("added_tokens") or [])
        # Words with a leading space: no normaliser, the byte-level pattern, spaces kept.
        self.spaced = plain and not self.suffix and not spec.get("normalizer") and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")
        # Words without white space: lower case, white space dropped by the pre-tokenizer's pattern.
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("type") for x in before.get("pretokenizers", [])]
        self.bare = plain and bool(self.suffix) and steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"] and before["pretokenizers"][0].get("invert") is True and "[\\p{L}]+" in json.dumps(before, ensure_ascii=False).replace("\\\\", "\\")

    def ids(self, text: str) -> list[int]:
        """As the library gives them for the whole text, without begin, end or added special tokens."""
        return self.tok.encode(text, add_special_tokens=False).ids

    @functools.cached_property
    def edges(self) -> np.ndarray:
        """By id: whether the token ends a pre-token, as its suffix says, or (without suffixes) begins with a space."""
        suffix = self.suffix
        return np.array([(p or "").endswith(suffix) if suffix else (p or "").startswith(SPACE) for p in map(self.tok.id_to_token, range(self.vocab_size))])

    def ids_of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, each of them one pre-token where a space stands before it, from one call of the library."""
        ids = np.array(self.tok.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edges[ids])
        if len(at) != len(parts):
            raise ValueError("the tokenizer divides words in another way than its file says")
        ends = [0, *((at[:-1] + 1 if self.suffix else at[1:]) * 4).tolist(), len(ids) * 4]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


@functools.cache
def library(path: str) -> Library:
    """One per worker process and file."""
    return Library(path)


class BareWords:
    """Ids of whole texts for tokenizers that lower-case and drop white space.

    No pre-token holds white space and normalisation never reaches across it, so an ASCII-white-space word is a unit. A text
    with one of the added strings goes through the library whole.
    """

    def __init__(self, path: str):
        self.lib = library(path)
        self.memo = Memo(self._units)
        self.merges = self.lib.merges() if self.lib.bare else None

    def _units(self, units: list[bytes]) -> list[bytes]:
        words = [u.decode() for u in units]
        split = [parts_of(w) for w in words]
        parts = list({p for s in split if s for p in s if p})
        spelled = [p.lower().encode() for p in parts]
        short = [i for i, x in enumerate(spelled) if len(x) <= Merges.LONGEST]
        raw = {"": b""} | {parts[i]: x for i, x in zip(short, self.merges.ids([spelled[i] for i in short]))}
        long = [p for p in parts if p not in raw]
        if long:
            raw |= zip(long, self.lib.ids_of_parts(long))
        return [raw[s[0]] + raw[s[1]] if s else np.array(self.lib.ids(w), "<u4").tobytes() for w, s in zip(words, split)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids per text."""
        if not self.lib.bare:
            return [np.array(self.lib.ids(t), "<u4").tobytes() for t in texts]
        # An added string counts only as it is spelled; a text that has one in other letters is no sum of its words either.
        added = [x.encode().lower() for x in self.lib.added]
        raw = [t.encode().lower() for t in texts]
        whole = {i for i, t in enumerate(raw) if any(x in t for x in added)}
        words = [[] if i in whole else t.split() for i, t in enumerate(raw)]
        return [np.array(self.lib.ids(t), "<u4").tobytes() if i in whole else b"".join(vs) for i, (t, vs) in enumerate(zip(texts, self.memo.values(words)))]


#: Before a space with one of these bytes after it, byte-level patterns always start a token: the byte starts no white space.
_REGULAR = re.compile(rb" (?=[\x21-\x7e\xc3-\xdf\xe4-\xf4])")
_ODD = re.compile(rb" (?![\x21-\x7e\xc3-\xdf\xe4-\xf4])")


class SpacedWords:
    """Numbers of tokens of whole texts for byte-level tokenizers that keep a space with the word after it.

    A match of the pattern never runs over the place before a space that a visible character follows: white space before it
    ends one character earlier, anything else ends at the space. So texts fall into units there. A text with one of the added
    strings goes through the library whole, because those strings end the stretch of white space before them.
    """

    def __init__(self, path: str):
        self.lib = library(path)
        self.memo = Memo(self._units)

    def _units(self, units: list[bytes]) -> list[int]:
        """Each of ``units`` follows a space."""
        words = [u.decode() for u in units]
        # The space stays with the letters after it, or with the signs where there are no letters.
        split = [(s[0] or s[1], s[1] if s[0] else "") if w and (s := parts_of(w)) else None for w in words]
        heads = list({s[0] for s in split if s})
        n = {h: len(x) // 4 for h, x in zip(heads, self.lib.ids_of_parts(heads))} if heads else {}
        signs = {t: len(self.lib.ids(t)) for t in {s[1] for s in split if s}}
        return [n[s[0]] + signs[s[1]] if s else len(self.lib.ids(" " + w)) for w, s in zip(words, split)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.lib.spaced:
            return [len(self.lib.ids(t)) for t in texts]
        heads, rests = [], []
        for t in texts:
            raw = t.encode()
            if any(x in t for x in self.lib.added):
                heads.append(t)
                rests.append([])
                continue
            first, *rest = _REGULAR.split(raw) if _ODD.search(raw) else raw.split(b" ")
            heads.append(first.decode())
            rests.append(rest)
        return [(len(self.lib.ids(h)) if h else 0) + sum(ns) for h, ns in zip(heads, self.memo.values(rests))]


@functools.cache
def bare_words(path: str) -> BareWords:
    """One per worker process and file, so that tasks share what is remembered."""
    return BareWords(path)


@functools.cache
def spaced_words(path: str) -> SpacedWords:
    return SpacedWords(path)
