from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import queries, tiff


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=20).map(lambda runs: b"".join(bytes([v]) * n for v, n in runs)))
def test_codecs(raw):
    assert tiff.unlzw(tiff.lzw(raw), len(raw)) == raw
    assert tiff.unpackbits(tiff.packbits(raw), len(raw)) == raw


def test_lzw_refills_its_table():
    raw = np.random.default_rng(0).bytes(60_000)
    assert tiff.unlzw(tiff.lzw(raw), len(raw)) == raw


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(scheme, predictor, tile, kind, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 250, (h, w, c)).astype(kind) for h, w, c in ((5, 7, 1), (61, 50, 3), (1, 1, 1))]
    got = list(tiff.read_pages(tiff.write_pages(pages, scheme, predictor, 20, tile, order)))
    assert len(got) == 3
    for a, b in zip(pages, got, strict=True):
        assert (a == b.samples).all() and (b.compression, b.predictor) == (scheme, predictor)


def test_bilevel_planar_and_float_predictor():
    bits = tiff.unpredict(bytes([0b10110000, 0b01000000]), 2, 4, 1, 1, 1, "<")
    assert bits[:, :, 0].tolist() == [[1, 0, 1, 1], [0, 1, 0, 0]]
    values = np.array([[1.5, -2.25, 3e9, 0.0]], ">f4")
    planes = values.view(np.uint8).reshape(1, 4, 4).transpose(0, 2, 1).reshape(1, 16)
    coded = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1)
    assert tiff.unpredict(coded.tobytes(), 1, 4, 1, 32, 3, "<", True)[:, :, 0].tolist() == values.tolist()


def test_damage_is_an_error(spark):
    whole = tiff.store(b"hello")
    loop = bytearray(whole)
    struct.pack_into("<I", loop, len(loop) - 4, struct.unpack_from("<I", loop, 4)[0])
    rows = [(1, None), (2, bytearray(b"")), (3, bytearray(whole[:-40])), (4, bytearray(b"II*\0")), (5, loop), (6, bytearray(whole))]
    got = {}
    for r in tiff.pages(spark.createDataFrame(rows, "k long, content binary"), "k", "content").collect():
        got.setdefault(r["k"], []).append(r["error"])
    assert all(got[k][-1] for k in (1, 2, 3, 4, 5)) and got[5][0] is None and got[6] == [None]


def test_long_texts_make_pages():
    text = b"x" * (tiff.ROW * tiff.PAGE_ROWS + 1)
    pages = list(tiff.read_pages(tiff.store(text)))
    assert [p.height for p in pages] == [tiff.PAGE_ROWS, 1]
    assert b"".join(p.samples.tobytes() for p in pages).rstrip(b"\0") == text


def test_op2_over_the_table(spark, data):
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got, feature = queries.op2_tiff(spark, data).collect(), {}
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert feature.setdefault(raw, (r["feature"], r["media_sha256"], r["media_bytes"])) == (r["feature"], r["media_sha256"], r["media_bytes"])


def test_op2_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (1, "é" * 100, None)], "doc_id long, text string, feature string")
    got = sorted((r["n_bytes"], r["payload_bytes"]) for r in tiff.features(tiff.media(df)).collect())
    assert got == [(0, 64), (0, 64), (200, 256)]
    assert tiff.features(tiff.media(df.limit(0))).count() == 0


def set_field(raw, page, tag, value):
    """Overwrites a field of one short in a little-endian file's directory."""
    out, (at,) = bytearray(raw), struct.unpack_from("<I", raw, 4)
    for _ in range(page):
        (at,) = struct.unpack_from("<I", raw, at + 2 + 12 * struct.unpack_from("<H", raw, at)[0])
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        if struct.unpack_from("<H", raw, at + 2 + 12 * k)[0] == tag:
            struct.pack_into("<I", out, at + 10 + 12 * k, value)
    return out


def test_a_page_that_cannot_be_read_does_not_end_its_file(spark):
    whole = tiff.write_pages([np.full((4, 6, 1), k, np.uint8) for k in range(3)], tiff.NONE)
    damaged = {1: (tiff.COMPRESSION, 7), 2: (tiff.STRIP_AT, 10**6), 3: (tiff.BITS, 24), 4: (tiff.PREDICTOR, 9), 5: (tiff.COMPRESSION, tiff.DEFLATE)}
    rows = [(k, set_field(whole, 1, *change)) for k, change in damaged.items()]
    got = {}
    for r in tiff.pages(spark.createDataFrame(rows, "k long, content binary"), "k", "content").collect():
        got.setdefault(r["k"], []).append((r["page"], bool(r["error"]), bytes(r["samples"])[:1] if r["samples"] else None))
    assert got == {k: [(0, False, b"\0"), (1, True, None), (2, False, b"\2")] for k in damaged}


def test_twelve_bits_are_unpacked_and_other_depths_are_errors():
    assert tiff.unpredict(bytes([0x12, 0x3A, 0xBC, 0xFF, 0xF0]), 1, 3, 1, 12, 1, "<")[0, :, 0].tolist() == [0x123, 0xABC, 0xFFF]
    for bits, predictor, floats in ((24, 1, False), (0, 1, False), (128, 1, False), (8, 1, True), (12, 2, False), (8, 3, False)):
        with pytest.raises(tiff.TiffError):
            tiff.unpredict(bytes(64), 1, 2, 1, bits, predictor, "<", floats)


#: Streams worked out by hand from the format's public description, with what they hold.
HAND = [
    # PackBits: FE AA = three times AA; 02 80 00 2A = three literals; FD AA = four times; 80 = nothing; 00 01 = one literal.
    (tiff.PACKBITS, "FE AA 02 80 00 2A FD AA 80 00 01", "AA AA AA 80 00 2A AA AA AA AA 01"),
    (tiff.PACKBITS, "81 07", "07 " * 128),
    # LZW, codes of nine bits: clear, 7, 258 (7 7), 8, 8, 258, 6, 6, end: 7 7 7 8 8 7 7 6 6.
    (tiff.LZW, None, "07 07 07 08 08 07 07 06 06"),
    # Clear, 65, end.
    (tiff.LZW, "80 10 60 20", "41"),
]


def packed(codes):
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


@pytest.mark.parametrize(("scheme", "stored", "plain"), HAND)
def test_streams_made_by_hand(scheme, stored, plain):
    raw = bytes.fromhex(stored) if stored else packed([256, 7, 258, 8, 8, 258, 6, 6, 257])
    want = bytes.fromhex(plain)
    assert tiff.unpack(raw, scheme, len(want)) == want


def test_lzw_width_grows_one_code_early():
    """With 9-bit codes up to number 510, the 511th entry makes the next code 10 bits wide: written here code by code."""
    data, codes, width, bits = bytes(range(256)) * 2, 258, 9, f"{256:09b}"
    for k, b in enumerate(data[:300]):  # a reader adds an entry for each code but the first
        bits += f"{b:0{width}b}"
        if k:
            codes += 1
        width = 10 if codes >= 511 else 9
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    raw = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    assert tiff.unlzw(raw, 300) == data[:300]


def by_hand(fields, strip):
    """A one-page little-endian file of short and long fields, sorted by tag."""
    fields = sorted({**{tiff.WIDTH: (4,), tiff.LENGTH: (1,), tiff.STRIP_AT: (8,), tiff.STRIP_BYTES: (len(strip),)}, **fields}.items())
    at = 8 + len(strip) + len(strip) % 2
    later, entries = b"", b""
    for tag, values in fields:
        data = struct.pack(f"<{len(values)}I", *values)
        where = at + 2 + 12 * len(fields) + 4 + len(later)
        entries += struct.pack("<HHI", tag, 4, len(values)) + (data if len(data) == 4 else struct.pack("<I", where))
        later += data if len(data) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, at) + strip + b"\0" * (len(strip) % 2) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + later


def test_kinds_of_samples():
    read = lambda fields, strip: next(tiff.each_page(by_hand(fields, strip)))
    page = read({tiff.BITS: (8,), tiff.SAMPLE_FORMAT: (2,)}, b"\xff\x80\x7f\0")
    assert page.samples.dtype == np.int8 and page.samples.ravel().tolist() == [-1, -128, 127, 0]
    page = read({tiff.BITS: (4,), tiff.SAMPLE_FORMAT: (2,)}, b"\xf7\x80")
    assert page.samples.ravel().tolist() == [-1, 7, -8, 0]
    page = read({tiff.BITS: (16,), tiff.SAMPLE_FORMAT: (2,), tiff.PREDICTOR: (2,)}, struct.pack("<4h", -5, 3, 3, -2))
    assert page.samples.ravel().tolist() == [-5, -2, 1, -1]
    assert read({tiff.BITS: (8,), tiff.FILL_ORDER: (2,)}, b"\x01\x80\xf0\x0f").samples.ravel().tolist() == [0x80, 1, 0x0F, 0xF0]
    assert read({tiff.BITS: (10,)}, bytes([0b00000000, 0b01000000, 0b00101111, 0b11111100, 0])).samples.ravel().tolist() == [1, 2, 1023, 0]
    for fields in ({tiff.BITS: (8, 16), tiff.SAMPLES: (2,)}, {tiff.BITS: (8, 8), tiff.SAMPLES: (2,), tiff.SAMPLE_FORMAT: (1, 2)}, {tiff.BITS: (24,)}, {tiff.BITS: (8,), tiff.SAMPLE_FORMAT: (3,)}, {tiff.BITS: (8,), tiff.SAMPLE_FORMAT: (6,)}, {tiff.WIDTH: (2**31,), tiff.BITS: (8,)}, {tiff.BITS: ()}):
        assert isinstance(read(fields, b"\0" * 64), (str, tiff.Page)) and (fields == {tiff.BITS: ()} or isinstance(read(fields, b"\0" * 64), str)), fields


def test_a_small_strip_cannot_fill_a_worker():
    bomb = zlib.compress(b"\0" * 50_000_000)
    page = next(tiff.each_page(by_hand({tiff.BITS: (8,), tiff.COMPRESSION: (tiff.DEFLATE,)}, bomb)))
    assert page.samples.ravel().tolist() == [0] * 4
    import tracemalloc

    tracemalloc.start()
    tiff.unpack(bomb, tiff.DEFLATE, 4)
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_damaged_files_never_raise(data):
    whole = bytearray(tiff.write_pages([np.arange(60, dtype=np.uint8).reshape(5, 12, 1)] * 2, data.draw(st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])), 2))
    for _ in range(data.draw(st.integers(1, 6))):
        whole[data.draw(st.integers(4, len(whole) - 1))] = data.draw(st.integers(0, 255))
    assert list(tiff.page_rows(bytes(whole)))
