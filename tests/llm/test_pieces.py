from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import huffman, pieces, queries

PATH = queries.vocabulary()
TRICKY = [
    "", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "x" * 3000, "ΟΔΟΣ ΣΑΣ", "é 각", "\x00\x01\x1c\x1f", "a b\u0085c　d", "it's 'S don'T''ll", "½Ⅷ１2³", "İstanbul ﬁ ẞ",
    "of.&&& then,... (x.) y,\nz.", "́a b̧́", "J̌ ǰ H̱ T̈.", "É.ß,... a×b÷c ×÷", "aİb i̇ I", "ŉn Ǆx ɏ. ɐ", "A1b22-3c", "",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(encoder, texts, library):
    got = encoder.encode([t.encode() for t in texts])
    assert len(got) == len(texts)
    for text, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("part", "cache"), [(1 << 20, 250_000), (1, 5), (7, 0), (64, 20)])
def test_whole_texts_ids_by_pieces(monkeypatch, library, part, cache):
    monkeypatch.setattr(pieces, "PART", part)
    monkeypatch.setattr(pieces, "CACHE", cache)
    monkeypatch.setattr(pieces, "JOINED", 3)
    encoder, rng = pieces.Encoder(PATH), random.Random(part)
    assert encoder.apart
    letters = "aAJbBzZ 'stsSσΣς<|endoftext|>́̌éẞİ×÷ŉǄɏ\u0085  \x1c\x1f​﻿1234½Ⅷ漢字𝒜😀ñß.,!?-_~\n\t\r\x0b\x0c  ﬁǅrE"
    for texts in ([], [""], ["", ""], TRICKY, TRICKY * 2, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]):
        check(encoder, texts, library)


def test_pieces_about_code_points(library):
    """All up to U+33FF, and every seventh after: in a word, after a letter that it may compose with, at a start and an end, by a digit, an accented letter and an apostrophe."""
    points = [chr(c) for c in [*range(0x3400), *range(0x3400, 0x110000, 7)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}B J{c} {c}.{c} É{c}x 1{c} '{c} " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    encoder = pieces.Encoder(PATH)
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert encoder.encode([t.encode() for t in texts]) == [np.array(e.ids, "<u4").tobytes() for e in want]


def test_the_library_is_asked_once_for_each_piece(monkeypatch):
    """Forty times the texts don't cost the library more; it had each whole text before, case, marks and all."""
    encoder = pieces.Encoder(PATH)
    asked, whole = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda text: asked.append(len(text)) or whole(text))
    rng, words = random.Random(4), ["Haus", "haus", "über", "don't", "漢字", "the", "2024", "end.", "end,"]
    texts = [" ".join(rng.choice(words) for _ in range(200)).encode() for _ in range(40)]
    first = encoder.encode(texts[:20])
    once = sum(asked)
    assert once < 100
    assert encoder.encode(texts * 40)[:20] == first and sum(asked) == once


@pytest.mark.parametrize("change", ["case", "special"])
def test_files_whose_pieces_are_not_apart_get_whole_texts(tmp_path, change):
    from tokenizers import Tokenizer

    with open(PATH) as f:
        spec = json.load(f)
    if change == "case":
        spec["normalizer"]["normalizers"].pop()
    else:
        spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 49408, "content": "[end]"})
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    encoder = pieces.Encoder(str(other))
    assert not encoder.apart
    check(encoder, ["The CAT, sat.[end]  on   <|endoftext|> it", ""], Tokenizer.from_file(str(other)))


def test_slices_take_every_row_once(monkeypatch):
    monkeypatch.setattr(huffman, "PART", 10)
    texts = pa.array([b"", b"x" * 50, b"", b"abc", b"abc", b"abcd", b"z", b"y" * 11, b""], pa.binary())
    got = list(huffman.slices(texts))
    assert [k for a, b in got for k in range(a, b)] == list(range(9))
    assert all(b - a == 1 or sum(map(len, texts[a:b].to_pylist())) <= 10 for a, b in got)
    assert list(huffman.slices(texts[:0])) == []


def test_long_texts_in_parts_through_files(spark, library):
    """One text of several parts, one word of more than a part, and none."""
    texts = ["Ein sehr langer Text, wirklich. " * 80_000, "ab" * 700_000, None, "kurz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in huffman.read_files(spark, huffman.token_files(spark, df, PATH)).collect()}
    for k, text in enumerate(texts):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k]["n_tokens"], got[k]["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))
