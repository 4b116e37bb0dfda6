"""SentencePiece encoding and decoding with a forward pass shared by common prefixes (operator 4)."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import keyed, made, slices, texts
from .memo import Memo

MARK = "▁"
#: Bytes of words that a worker remembers, and pairs of pieces of which it knows whether one may follow the other (about 200 bytes each).
TABLE_BYTES, PAIRS = 48 << 20, 200_000


class PieceModel:
    """The pieces of a BPE model file and the forward pass over sorted words.

    A prefix has one valid segmentation, so its last piece is all that the forward pass must know: the score of a prefix is
    reached by the one piece that ends there and may follow the last piece of what stands before it. Sorted words form a
    trie; walked depth-first, the cells of a common prefix are computed once.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with identity normalisation, kept white space and a leading mark is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = pb.ModelProto.SentencePiece
        self.unk_id = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.text = [p.piece for p in proto.pieces]
        self.bytes_of = [bytes([int(p.piece[3:-1], 16)]) if p.type == kinds.BYTE else p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL or p.type == kinds.USER_DEFINED else b"" if p.type == kinds.CONTROL else " ⁇ ".encode()
                         for p in proto.pieces]
        self.byte_id = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        normal = [(p.score, i, p.piece) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        # Merges go from the highest score down; equal scores share a rank and the leftmost goes first.
        order = {s: r for r, s in enumerate(sorted({s for s, _, _ in normal}, reverse=True))}
        self.id_of = {piece: i for _, i, piece in normal}
        self.rank = {piece: order[s] if len(piece) > 1 else -1 for s, _, piece in normal}
        self.halves: dict[str, tuple[str, str]] = {}
        for piece in sorted(self.id_of, key=len):
            if len(piece) > 1:
                found = self.merged(piece, stop=2)
                if len(found) == 2:
                    self.halves[piece] = (found[0], found[1])
        self.tails = {piece[i:] for piece in self.halves for i in range(len(piece))}
        self.follows: dict[tuple[str, str], bool] = {}
        # Only with every piece starting a word at its mark do words stand alone.
        self.marks_lead = all(MARK not in piece[1:] or not piece.strip(MARK) for piece in self.id_of)

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Merge neighbours by rank, leftmost first, until nothing merges; with ``stop`` 2, until two parts are left."""
        parts, rank = list(text), self.rank
        while len(parts) > stop:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` ends in exactly these two pieces.

        The merges of both are undone from the last one; a pair across the border that outranks the merge just undone would
        have been taken before it.
        """
        key = (left, right)
        known = self.follows.get(key)
        if known is not None:
            return known
        rank, halves, limit, good = self.rank, self.halves, float("inf"), True
        while True:
            across = rank.get(left + right)
            if across is not None and across < limit:
                good = False
                break
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                limit, left = a, halves[left][1]
            else:  # of two merges of one rank the left one is taken first, so the right one is undone first
                limit, right = b + 0.5, halves[right][0]
        if len(self.follows) >= PAIRS:
            self.follows.clear()
        self.follows[key] = good
        return good

    def segment(self, words: list[str]) -> dict[str, list[int]]:
        """The ids of distinct words (each with its marks), by one depth-first walk over the trie of the sorted words."""
        out, before = {}, ""
        cells: list[tuple[str, int]] = [("", 0)]  # by prefix length: the last piece and where it starts
        halves, tails, may_follow = self.halves, self.tails, self.may_follow
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del cells[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                piece = word[start]
                # Exactly one piece fits, so the first one found ends the search.
                while start and not ((piece in halves or start == end - 1) and may_follow(cells[start][0], piece)):
                    start -= 1
                    piece = word[start:end]
                    if piece not in tails or not start and piece not in halves:
                        raise ValueError(f"no piece of the model ends {word[:end]!r}")
                cells.append((piece, start))
            before = word
            found, at = [], len(word)
            while at:
                piece, at = cells[at]
                i = self.id_of.get(piece)
                if i is not None:
                    found.append(i)
                else:
                    found += [self.byte_id.get(b, self.unk_id) for b in reversed(piece.encode())] if self.byte_id else [self.unk_id]
            out[word] = found[::-1]
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes put together, the leading mark dropped."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.cache
def model(path: str) -> PieceModel:
    """One per worker process and file."""
    return PieceModel(path)


_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """Ids of whole texts: distinct marked words of a slice that are not remembered are segmented together."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        self.model = model(path)
        self.memo = Memo(self._segmented, limit)

    def _segmented(self, units: list[str]) -> list[bytes]:
        found = self.model.segment([MARK + u for u in units])
        return [np.array(found[MARK + u], "<u4").tobytes() for u in units]

    def encode(self, all_texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids per text."""
        if not self.model.marks_lead:
            whole = self.model.segment(sorted({MARK + t.replace(" ", MARK) for t in all_texts if t}))
            return [np.array(whole[MARK + t.replace(" ", MARK)] if t else [], "<u4").tobytes() for t in all_texts]
        units = []
        for t in all_texts:
            if not t:
                units.append([])
            elif "  " in t or MARK in t or t[0] == " ":
                units.append([u[1:] for u in _UNIT.findall(MARK + t.replace(" ", MARK))])
            else:
                units.append(t.split(" "))
        return [b"".join(vs) for vs in self.memo.values(units)]


@functools.cache
def remembering(path: str) -> Pieces:
    """One per worker process and file, so that tasks share what is remembered."""
    return Pieces(path)


def _lists(found: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(x) // 4 for x in found]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row: the ids that the model file's library gives for the whole text.

    Row-local: no shuffle, memory bounded by a slice of text and a table of remembered words. Null and empty texts have no
    ids; repeated rows are encoded each; a null id stays null; other columns are ignored. A space mark inside a text counts
    as a space, as in the library.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        pieces = remembering(path)
        for part in slices(batches):
            yield made(schema, part.column("k"), _lists(pieces.encode(texts(part))))

    return keyed(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``(doc_id, text)`` for every row of ids; null and empty ids are an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        pieces = model(path)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield made(schema, part.column("k"), [pieces.decode(x or []) for x in part.column("ids").to_pylist()])

    return encoded.selectExpr(f"cast(`{id_column}` as bigint) as k", f"`{ids_column}` as ids").mapInArrow(run, "doc_id bigint, text string")


DIGESTS = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, n_decoded bigint, same boolean"


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every row: ``(doc_id, n_tokens, ids_crc32, n_decoded, same)``.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers, ``n_decoded`` the code points of the decoded
    text, ``same`` whether it equals the text (false only where a text holds the space mark itself). ``with_ids`` adds ``ids``.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_decoded", pa.int64()), ("same", pa.bool_())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        pieces = remembering(path)
        for part in slices(batches):
            given = texts(part)
            found = pieces.encode(given)
            decoded = [pieces.model.decode(np.frombuffer(x, "<u4").tolist()) for x in found]
            yield made(schema, part.column("k"), [len(x) // 4 for x in found], [zlib.crc32(x) for x in found], [len(d) for d in decoded],
                       [a == b for a, b in zip(given, decoded)], *([_lists(found)] if with_ids else []))

    return keyed(docs, id_column, text_column).mapInArrow(run, DIGESTS + (", ids array<int>" if with_ids else ""))
