from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe, huffman, queries

PATH = queries.vocabulary()
TRICKY = ["", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "x" * 3000, "ab" * 4000, "ΟΔΟΣ ΣΑΣ", "é 각", "\x00\x01\x1c\x1f", "a b\u0085c　d", "it's 'S don'T''ll", "½Ⅷ１2³", "漢字 仮名 😀👍🏽", "İstanbul ﬁ ẞ", "of.&&& then,... (x.) y,\nz.", "́a b̧́"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def both(texts):
    own, cache = bpe.load(PATH)
    whole, _ = huffman.library(PATH)
    return own, list(bpe.encode_texts([t.encode() for t in texts], cache, own.encode_chunks)), [whole(t).tobytes() for t in texts]


def check(texts, library):
    own, mine, whole = both(texts)
    for text, a, b in zip(texts, mine, whole, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(a) == want, text
        assert ids(b) == want, text
        assert own.decode(np.array(want)) == library.decode(want, skip_special_tokens=False)


def test_like_the_library(library):
    rng = random.Random(1)
    letters = "aAbBzZ 'stsSσΣς<|endoftext|>́éẞİ\u0085  \x1c\x1f​﻿1234½Ⅷ漢字𝒜😀ñß.,!?-_~\n\t\r\x0b\x0c  ﬁǅrE"
    check(TRICKY + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)], library)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=30))
def test_like_the_library_on_any_text(text):
    from tokenizers import Tokenizer

    check([text], Tokenizer.from_file(PATH))


def test_like_the_library_on_every_code_point(library):
    """Each within a word, at its start and end, and after a mark; all but surrogates, which no UTF-8 text has."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}B {c}.{c} " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    own, cache = bpe.load(PATH)
    for at in range(0, len(texts), 1024):
        part = texts[at : at + 1024]
        raw = [t.encode() for t in part]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(part, add_special_tokens=False)]
        assert list(bpe.encode_texts(raw, cache, own.encode_chunks)) == want


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}, {"lower": None}])
def test_other_tokenizers_are_refused_or_the_librarys(tmp_path, change):
    """BPE takes no steps but its own; token files take what the library takes."""
    import json

    from tokenizers import Tokenizer

    with open(PATH) as f:
        spec = json.load(f)
    if "lower" in change:
        spec["normalizer"]["normalizers"].pop()
    else:
        spec |= change
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="cannot encode"):
        bpe.BPE(str(other))
    encode, _ = huffman.library(str(other))
    text = "The CAT, sat.  on   <|endoftext|> it"
    assert encode(text).tolist() == Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids


def test_small_cache_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "ROWS", 3)
    check(TRICKY * 2, library)


def test_query_on_odd_rows(spark, library):
    df = spark.createDataFrame([(1, None, "x"), (None, "the cat", "y"), (1, "the cat", None), (2, "", ""), (2, "", "")], "doc_id long, text string, n_tokens string")
    got = bpe.encode_decode(df, PATH, texts=True).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["decoded"]) for r in got), key=repr) == sorted([(1, 0, ""), (None, 2, "the</w> cat</w>"), (1, 2, "the</w> cat</w>"), (2, 0, ""), (2, 0, "")], key=repr)
    assert got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_op5_over_the_table(spark, data, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op5_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_code_is_optimal_and_limited(seed):
    rng = np.random.default_rng(seed)
    counts = (rng.pareto(0.5, 300) * 3).astype(np.int64)
    counts[rng.random(300) < 0.3] = 0
    lengths = huffman.code_lengths(counts, 12)
    used = lengths[counts > 0]
    assert (lengths[counts == 0] == 0).all() and used.min() >= 1 and used.max() <= 12
    assert sum(2.0 ** -int(x) for x in used) == 1
    import heapq

    heap = [int(c) for c in counts[counts > 0]]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    free = huffman.code_lengths(counts, 40)
    assert int((free.astype(np.int64) * counts).sum()) == cost  # without a limit it is Huffman's
    assert int((lengths.astype(np.int64) * counts).sum()) >= cost


@pytest.mark.parametrize("sizes", [[], [0], [1], [255, 256, 257, 0, 3], [40_000]])
def test_file_round_trip_and_single_blocks(sizes):
    rng = np.random.default_rng(3)
    docs = [np.minimum(rng.geometric(0.02, n), 999).astype(np.int64) for n in sizes]
    counts = np.bincount(np.concatenate([*docs, [0, 1]]).astype(np.int64), minlength=1000)
    lengths = huffman.code_lengths(counts)
    raw = huffman.write_file(docs, lengths, huffman.canonical(lengths))
    got, all_ids = huffman.read_file(raw)
    assert got.tolist() == sizes
    assert all_ids.tolist() == [int(x) for d in docs for x in d]
    if len(all_ids) > 600:  # one block without the others
        _, one = huffman.read_file(raw, slice(1, 2))
        assert one.tolist() == all_ids[huffman.BLOCK : 2 * huffman.BLOCK].tolist()
    with pytest.raises(ValueError):
        huffman.read_file(b"nope" + raw[4:])


def test_one_id_alone():
    lengths = huffman.code_lengths(np.array([0, 7, 0]))
    assert lengths.tolist() == [0, 1, 0]
    assert huffman.read_file(huffman.write_file([np.array([1, 1, 1])], lengths, huffman.canonical(lengths)))[1].tolist() == [1, 1, 1]


def test_op1_over_the_table(spark, data, library, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 5_000)
    got = sorted(queries.op1_token_files(spark, data).collect(), key=lambda r: r["doc_id"])
    start = 0
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for r, d in zip(got, docs, strict=True):
        want = np.array([*library.encode(d["text"], add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_op1_on_odd_rows(spark):
    df = spark.createDataFrame([(5, None, 1), (5, "a b", 2), (None, "c", 3), (-3, "", 4)], "doc_id long, text string, start long")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in huffman.read_files(spark, huffman.token_files(spark, df, PATH)).collect()), key=lambda r: r[0])
    assert [g[1] for g in got] == [None, -3, 5, 5] and [g[0] for g in got] == [0, 2, 3, *[3 + got[2][2]]]
    assert huffman.read_files(spark, huffman.token_files(spark, df.limit(0), PATH)).count() == 0


def test_codes_that_fill_the_top_bit():
    """Every place of a code in its word, and the longest codes: integers alone, no float in between."""
    counts = np.r_[np.int64(2) ** np.arange(40), 1, 1]
    lengths = huffman.code_lengths(counts)
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, len(counts), n) for n in (20_000, 0, 300)]
    raw = huffman.write_file(docs, lengths, huffman.canonical(lengths), [None, None, 2**40])
    assert huffman.read_ids(raw) == [None, None, 2**40]
    assert huffman.read_file(raw)[1].tolist() == np.concatenate(docs).tolist()
    with pytest.raises(ValueError):
        huffman.write_file(docs, lengths, huffman.canonical(lengths), [1, None, 2])


def test_one_id_on_most_rows_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(huffman, "TASK_IDS", 40_000)
    monkeypatch.setattr(huffman, "FILE_IDS", 20_000)
    df = spark.range(100_000).selectExpr("CASE WHEN id % 10 = 0 THEN id ELSE 7 END AS doc_id", "'a b' AS text").repartition(4)
    files = huffman.token_files(spark, df, PATH)
    tasks = {r["part"]: r["n"] for r in huffman.decode_files(files).where("doc_id = 7").groupBy(F.substring("path", 1, 10).alias("part")).agg(F.count("*").alias("n")).collect()}
    assert len(tasks) >= 5 and max(tasks.values()) < 40_000 and sum(tasks.values()) == 90_000
    got = huffman.read_files(spark, files).orderBy("start").collect()
    assert [r["start"] for r in got] == list(range(0, 300_000, 3))
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)


def test_very_long_text_through_files(spark, library):
    text = "Ein sehr langer Text, wirklich. " * 40_000
    df = spark.createDataFrame([(1, "short"), (2, text), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in huffman.read_files(spark, huffman.token_files(spark, df, PATH)).collect()}
    want = [*library.encode(text, add_special_tokens=False).ids, 1]
    assert got[2]["n_tokens"] == len(want) and got[2]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    assert (got[3]["n_tokens"], got[3]["start"]) == (1, got[1]["n_tokens"] + len(want))


def test_long_words_by_windows_are_the_library_s():
    """Words of random letters, of few letters, of one, of tokens and of parts that repeat, about the bound and far over it."""
    path = queries.vocabulary()
    own, library, rnd = bpe.BPE(path), bpe.library_tokenizer(path), random.Random(9)
    tokens = [t for t in (x.removesuffix("</w>") for x in own.tokens[300:20_000]) if t.isascii() and t.isalpha()]
    for k in range(250):
        n = rnd.choice([255, 256, 300, 700, 3000])
        pick = [lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz"), lambda: rnd.choice("ab"), lambda: "x", lambda: rnd.choice(tokens), lambda: rnd.choice(["the", "a", "aa", "ing", "ss", "sss", "é", "日"])][k % 5]
        word = "".join(pick() for _ in range(n))
        words = own.words(word)
        assert own.encode_words(words)[0].tolist() == library.encode(word, add_special_tokens=False).ids


def test_a_long_word_takes_rounds_that_do_not_grow():
    """80,000 letters in a few seconds at most (some 11 before windows), and each merge round takes many pairs."""
    own, rnd = bpe.BPE(queries.vocabulary()), random.Random(3)
    rounds = []
    rank, own._rank = own._rank, lambda sym, word: rounds.append(len(sym)) or rank(sym, word)
    counts = []
    for n in (20_000, 80_000):
        own.encode_long("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode())
        counts.append(len(rounds))
        rounds.clear()
    assert counts[1] < 1.5 * counts[0]


def test_long_chunks_are_not_cached():
    own, cache = bpe.BPE(queries.vocabulary()), {}
    list(bpe.encode_texts([b"short " + b"x" * 500 + b" short"], cache, own.encode_chunks))
    assert set(cache) == {b"short"}
