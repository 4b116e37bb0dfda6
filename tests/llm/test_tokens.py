"""Token counts, packed ids and pieces against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from vitrine.llm import memo, pieces, token_counts, token_store
from vitrine.llm.frames import shared_folder

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", "Hello  world\n x é", " a", "a ", "  ", "\n", "a▁b", "日本語 текст ’s don't I'll 's", "x" * 300, "the   the    \t q <|endoftext|> z", "  <|endoftext|>", "a  b c 　d",
       "ŒUVRE ǅ İstanbul ΣΑΣ", "...?!. , ,. a.b.c 1234 12 3", "\x1c \x1f x\x85y  \r\n z", "é ́x", "<|ENDOFTEXT|> <|startoftext|>x"]


def strange(n, length=60, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab the\n  ▁.,é'sIİß 　x1𝒳<|>") for _ in range(rng.randint(1, length))) for _ in range(n)]


def rows_of(spark, texts):
    """Rows with a clashing name, a null text, a null id and a repeated row."""
    rows = [(i, t, "k", i) for i, t in enumerate(texts)] + [(len(texts), None, "k", 0), (None, "null id", "t", 1), (0, texts[0], "t", 2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, t string, k int"), [(r[0], r[1] or "") for r in rows]


def test_counts_are_the_librarys(spark):
    df, rows = rows_of(spark, ODD + strange(300) + strange(40, 900, 5))
    tok = Tokenizer.from_file(BYTES)
    expected = sorted(((k, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for k, t in rows), key=repr)
    for options in ({}, {"chunk": 50, "overlap": 8}):
        assert sorted(map(tuple, token_counts.count_tokens(df, BYTES, **options).collect()), key=repr) == expected


@pytest.mark.parametrize(("chunk", "overlap"), [(30, 4), (64, 16), (500, 64)])
def test_spliced_chunks_equal_the_whole(chunk, overlap):
    tok = Tokenizer.from_file(BYTES)
    encode = token_counts._with_starts(tok)
    for text in [*strange(60, 900, 8), "x" * 2000, "word " * 300, " " * 700 + "end"]:
        assert token_counts.spliced(encode, text, chunk, overlap) == tok.encode(text, add_special_tokens=False).ids


def test_packed_ids_come_back_in_order(spark):
    df, rows = rows_of(spark, ODD + strange(200))
    tok = Tokenizer.from_file(WORDS)
    path = shared_folder(spark, "test")
    token_store.write_ids(df, path, WORDS, block_ids=500)
    blocks = token_store.read_ids(spark, path)
    assert blocks.count() > 5 and {r["bits"] for r in blocks.select("bits").collect()} == {16}
    found = token_store.per_document(blocks).orderBy("start").collect()
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda k: -1 if k is None else k)
    want = sorted((str(k), zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in found) == want
    one = token_store.documents_at(blocks, df.filter(F.col("doc_id") == 5)).collect()
    assert one[0]["ids"] == [*tok.encode(ODD[5], add_special_tokens=False).ids, 2]


def test_words_of_any_kind_with_a_table_that_forgets():
    lib, counts = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéßÉthn") for _ in range(rng.choice([1, 2, 5, 9, 24, 25, 40]))) + rng.choice(["", "", ".", "!!", "$$$", "'s", "-x"]) for _ in range(800)]
    given = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["<|ENDOFTEXT|> a", "A<|EndOfText|>b", "##  ..", "ªº µ ½"]
    bare, spaced = memo.BareWords(WORDS), memo.SpacedWords(BYTES)
    bare.memo.limit = spaced.memo.limit = 40_000
    for i in range(0, len(given), 10):
        some = given[i:i + 10]
        assert [np.frombuffer(x, "<u4").tolist() for x in bare.encode(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]
        assert spaced.count(some) == [len(counts.encode(t, add_special_tokens=False).ids) for t in some]
    assert len(bare.memo.young) + len(bare.memo.old) < 400


@pytest.mark.parametrize("bits", range(1, 33))
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
    payload = token_store.pack(ids, bits)
    assert len(payload) == (1000 * bits + 7) // 8
    assert (token_store.unpack(payload, bits, 0, 1000) == ids).all() and (token_store.unpack(payload, bits, 137, 55) == ids[137:192]).all()
    assert len(token_store.unpack(payload, bits, 3, 0)) == 0


def test_pieces_are_the_librarys_and_decode(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    df, rows = rows_of(spark, ODD + strange(800))
    encoded = pieces.encode(df, PIECES)
    want = sorted(((k, lib.encode(t)) for k, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=repr) == want
    assert sorted(map(tuple, pieces.decode(encoded, PIECES).collect()), key=repr) == sorted(((k, lib.decode(lib.encode(t))) for k, t in rows), key=repr)
    for r in pieces.round_trip(df, PIECES, with_ids=True).collect():
        assert r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_common_prefixes_change_nothing():
    model = pieces.model(PIECES)
    words = ["▁" + w for t in strange(300, 30, 11) for w in t.replace("▁", "").split()]
    together = model.segment(words)
    assert all(model.segment([w])[w] == ids == [model.id_of[p] for p in model.merged(w) if p in model.id_of] or any(c not in model.id_of for c in w) for w, ids in together.items())


def test_a_full_table_changes_nothing():
    texts = ODD + strange(200)
    for kind, call in ((memo.BareWords, "encode"), (memo.SpacedWords, "count")):
        small, large = kind(WORDS if kind is memo.BareWords else BYTES), kind(WORDS if kind is memo.BareWords else BYTES)
        small.memo.limit = 3
        assert [getattr(small, call)([t])[0] for t in texts] == getattr(large, call)(texts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(none, BYTES).count() == token_store.packed_digests(none, WORDS).count() == pieces.encode(none, PIECES).count() == 0
