"""TIFF pages as rows.

``read_pages`` walks a file's chain of image directories (either byte order), decodes strips or tiles under no
compression, PackBits, LZW or deflate, undoes the horizontal predictor (8, 16, 32 and 64 bits) and the floating
point one, and yields a page at a time. Samples have 1 to 16, 32 or 64 bits, all of a page alike in bits and kind: unsigned, signed or floating point,
interleaved or planar, grey, colour or palette. FillOrder 2 (bits from the least significant on) is undone. ``pages`` is
the same over a DataFrame, one row per page. ``write_pages`` makes such files.

``store`` keeps texts as images: UTF-8 bytes and zeros up to a positive multiple of 64, in pages of 64
columns and at most PAGE_ROWS rows, deflate strips with the horizontal predictor. Nothing but the text
goes into a file, so equal texts have equal files. Texts of any length are stored whole, in as many pages as they need.

A strip or tile is inflated to the bytes that its shape takes and no further, and a page of more than PAGE_BYTES is an error row: a
few stored bytes can't fill a worker.

Rows: a null text counts as empty and makes one page of one row of zeros. Repeated rows and null ids stay.
A page that can't be read gives a row of ``pages`` with nulls for its samples and shape and the reason in ``error``; the pages after
it follow. An empty table gives an empty result. Null or empty content, and a directory chain that can't be walked further or loops, end in such a row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import text_bytes

#: Fixed values of the format: tag numbers, sizes of field types, compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES, SAMPLE_FORMAT = 266, 284, 317, 322, 323, 324, 325, 339
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257

ROW, PAGE_ROWS, ROWS_IN_STRIP = 64, 16_384, 1_024
#: Bytes of a page's samples at most: a cell of a Spark row holds 2 GB.
PAGE_BYTES = 512 << 20
#: Each byte with its bits the other way round.
REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


@dataclass
class Page:
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    predictor: int
    samples: np.ndarray  # height x width x channels


class TiffError(ValueError):
    pass


# --- codecs ---------------------------------------------------------------------------------------------------


def unpackbits(raw: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < size:
        n = raw[at]
        at += 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits(raw: bytes) -> bytes:
    """Runs of three or more equal bytes, and literals between them, 128 at most."""
    if not raw:
        return b""
    data = np.frombuffer(raw, np.uint8)
    start = np.flatnonzero(np.r_[True, data[1:] != data[:-1]])
    length = np.diff(np.r_[start, len(data)])
    out, literal = bytearray(), 0

    def literals(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = raw[k : min(b, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        literals(literal, s)
        for k in range(0, n, 128):
            m = min(128, n - k)
            out.extend((0, raw[s]) if m == 1 else (257 - m, raw[s]))
        literal = s + n
    literals(literal, len(raw))
    return bytes(out)


def unlzw(raw: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths grow one code early, as TIFF has it."""
    out, table = bytearray(), [bytes((k,)) for k in range(256)] + [b"", b""]
    held, bits, width, last = 0, 0, 9, b""
    for byte in raw:
        held = (held & 0xFFFFFF) << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == END or len(out) >= size:
            break
        if code == CLEAR:
            del table[258:]
            width, last = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def lzw(raw: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table: dict[bytes, int] = {}
    width, following, word = 9, 258, b""
    put(CLEAR, 9)
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0], width)
        table[longer] = following
        following += 1
        if following == 4094:  # the reader's table stays below 4,096 codes
            put(CLEAR, 12)
            table, width, following = {}, 9, 258
        else:
            width = max(9, following.bit_length())
        word = longer[-1:]
    if word:
        put(table[word] if len(word) > 1 else word[0], width)
        following += 1
        width = min(12, max(9, following.bit_length()))
    put(END, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def unpack(raw: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        return raw
    if scheme in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(raw, max(1, size))
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    if scheme == LZW:
        return unlzw(raw, size)
    if scheme == PACKBITS:
        return unpackbits(raw, size)
    raise TiffError(f"compression {scheme}")


PACK = {NONE: bytes, DEFLATE: lambda b: zlib.compress(b, 1), LZW: lzw, PACKBITS: packbits}


def unpredict(block: bytes, rows: int, cols: int, channels: int, bits: int, predictor: int, order: str, floats: bool = False, signed: bool = False) -> np.ndarray:
    """Samples of a decoded strip or tile, rows x cols x channels."""
    if bits not in (8, 16, 32, 64) and not 0 < bits < 16 or floats and bits < 16:
        raise TiffError(f"samples of {bits} bits")
    if predictor not in (1, 2, 3) or predictor > 1 and bits not in (8, 16, 32, 64) or predictor == 3 and bits < 16:
        raise TiffError(f"predictor {predictor} with {bits} bits")
    if bits not in (8, 16, 32, 64):  # most significant bit first in either byte order
        per_row = (cols * channels * bits + 7) // 8
        flat = np.frombuffer(block, np.uint8, per_row * rows).reshape(rows, per_row)
        every = np.unpackbits(flat, axis=1)[:, : cols * channels * bits].reshape(rows, cols * channels, bits)
        values = every @ (1 << np.arange(bits)[::-1])
        if signed:
            values = values - (values >> bits - 1 << bits)
        return values.astype(f"{'i' if signed else 'u'}{1 if bits < 8 else 2}").reshape(rows, cols, channels)
    kind = np.dtype(f"{order}{'f' if floats else 'i' if signed else 'u'}{bits // 8}")
    if predictor == 3:
        flat = np.frombuffer(block, np.uint8, rows * cols * channels * bits // 8).reshape(rows, -1, channels)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, bits // 8, cols * channels)
        big = np.ascontiguousarray(planes.transpose(0, 2, 1))
        return big.view(np.dtype(f">f{bits // 8}")).reshape(rows, cols, channels)
    data = np.frombuffer(block, kind, rows * cols * channels).reshape(rows, cols, channels)
    if predictor == 2:
        native = data.astype(kind.newbyteorder("="))
        return np.cumsum(native, axis=1, dtype=native.dtype)
    return data


# --- files ----------------------------------------------------------------------------------------------------


def directory(raw: bytes, order: str, at: int, n: int) -> dict[int, tuple] | TiffError:
    """The fields of a directory, or why they can't be read."""
    fields = {}
    try:
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(f"{order}HHI", raw, entry)
            if kind not in TYPE_SIZE:
                continue
            where = entry + 8 if TYPE_SIZE[kind] * count <= 4 else struct.unpack_from(f"{order}I", raw, entry + 8)[0]
            if kind in (2, 7):
                fields[tag] = (raw[where : where + count],)
            elif kind in (5, 10):
                fields[tag] = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", raw, where)
            else:
                fields[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 6: 'b', 8: 'h', 9: 'i', 11: 'f', 12: 'd'}[kind]}", raw, where)
    except struct.error as e:
        return TiffError(f"cut off: {e}")
    return fields


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple] | TiffError]]:
    """The byte order, and the fields of each directory."""
    if raw[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("not a TIFF file")
    order = "<" if raw[:2] == b"II" else ">"
    (at,), seen = struct.unpack_from(f"{order}I", raw, 4), set()
    if not at:
        raise TiffError("a file without a directory")
    try:
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(f"{order}H", raw, at)
            fields = directory(raw, order, at, n)
            if isinstance(fields, TiffError) and at + 6 + 12 * n > len(raw):
                raise fields  # the chain ends with it
            yield order, fields
            (at,) = struct.unpack_from(f"{order}I", raw, at + 2 + 12 * n)
    except struct.error as e:
        raise TiffError(f"cut off: {e}") from e


def each_page(raw: bytes) -> Iterator[Page | str]:
    """Pages, or the reason where one can't be read."""
    for order, fields in directories(raw):
        try:
            if isinstance(fields, TiffError):
                raise fields
            yield read_page(raw, order, fields)
        except Exception as e:  # whatever a damaged page leads to is its own error and no one else's
            yield f"{type(e).__name__}: {e}"


def read_pages(raw: bytes) -> Iterator[Page]:
    for page in each_page(raw):
        if isinstance(page, str):
            raise TiffError(page)
        yield page


def read_page(raw: bytes, order: str, f: dict[int, tuple]) -> Page:
    one = lambda tag, default=None: f[tag][0] if f.get(tag) else default
    width, height, channels, bits = one(WIDTH), one(LENGTH), one(SAMPLES, 1), one(BITS, 1)
    if len(set(f.get(BITS, ()))) > 1:
        raise TiffError(f"samples of {', '.join(map(str, f[BITS]))} bits")
    if not width or not height:
        raise TiffError("a directory without a size")
    planar, predictor, scheme = one(PLANAR, 1) == 2, one(PREDICTOR, 1), one(COMPRESSION, 1)
    kinds = {1 if k == 4 else k for k in f.get(SAMPLE_FORMAT, (1,))}  # undefined data (4) is read as unsigned
    if len(kinds) > 1 or not kinds <= {1, 2, 3}:
        raise TiffError(f"samples of format {', '.join(map(str, f[SAMPLE_FORMAT]))}")
    floats, signed = 3 in kinds, 2 in kinds
    if width * height * channels * max(8, bits) // 8 > PAGE_BYTES:
        raise TiffError(f"a page of more than {PAGE_BYTES} bytes")
    tiled = TILE_AT in f
    if tiled:
        tw, th, where, sizes = one(TILE_WIDTH), one(TILE_LENGTH), f[TILE_AT], f.get(TILE_BYTES)
    else:
        tw, th, where, sizes = width, min(one(STRIP_ROWS, height), height), f.get(STRIP_AT), f.get(STRIP_BYTES)
    if not where or not sizes or not tw or not th:
        raise TiffError("a directory without strips or tiles")
    across, down, deep = -(-width // tw), -(-height // th), channels if planar else 1
    if min(len(where), len(sizes)) < across * down * deep:
        raise TiffError("strips or tiles are missing")
    inner, out = 1 if planar else channels, None
    for k in range(across * down * deep):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, height - y)
        size = (tw * inner * bits + 7) // 8 * rows
        if size > 2 * PAGE_BYTES:
            raise TiffError("a tile far larger than its page may be")
        stored = raw[where[k] : where[k] + sizes[k]]
        block = unpack(stored.translate(REVERSED) if one(FILL_ORDER, 1) == 2 else stored, scheme, size)
        if len(block) < size:
            raise TiffError("a strip or tile is cut off")
        got = unpredict(block[:size], rows, tw, inner, bits, predictor, order, floats, signed)
        if out is None:
            out = np.zeros((height, width, channels), got.dtype)
        got = got[: height - y, : width - x]
        if planar:
            out[y : y + th, x : x + tw, plane] = got[:, :, 0]
        else:
            out[y : y + th, x : x + tw] = got
    return Page(width, height, channels, bits, scheme, predictor, out)


def write_pages(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, rows_in_strip: int = ROWS_IN_STRIP, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of unsigned samples, each height x width x channels; ``tile``: its rows and columns, multiples of 16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        height, width, channels = page.shape
        th, tw = tile or (min(rows_in_strip, height), width)
        where, sizes = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = page[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                raw = PACK[scheme](np.ascontiguousarray(block.astype(page.dtype.newbyteorder(order))).tobytes())
                where.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8 * page.itemsize] * channels), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [2 if channels >= 3 else 1])]
        fields += [(SAMPLES, 3, [channels]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tw]), (TILE_LENGTH, 4, [th]), (TILE_AT, 4, where), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, where), (STRIP_ROWS, 4, [th]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                data, at = struct.pack(f"{order}I", len(out)), data
                out += at + b"\0" * (len(at) % 2)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def page_rows(raw: bytes | None) -> Iterator[tuple[int, Page | None, str | None]]:
    """Page number, page and error: only a chain of directories that can't be walked further ends its file."""
    n = 0
    try:
        for page in each_page(raw or b""):
            yield (n, None, page) if isinstance(page, str) else (n, page, None)
            n += 1
    except Exception as e:  # the chain itself
        yield n, None, f"{type(e).__name__}: {e}"


PAGE_SCHEMA = "page int, width int, height int, channels int, bits int, compression int, predictor int, samples binary, error string"


def pages(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row per page: the key, its number and shape, and the samples (row by row, channels interleaved, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for n, p, error in page_rows(batch.column(1)[k].as_py()):
                    cells = [n, *((p.width, p.height, p.channels, p.bits, p.compression, p.predictor, p.samples.astype(p.samples.dtype.newbyteorder("<")).tobytes()) if p else (None,) * 7), error]
                    kinds = [pa.int32()] * 7 + [pa.binary(), pa.string()]
                    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([c], t) for c, t in zip(cells, kinds, strict=True))], [key, *names])

    return df.select(key, content).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {PAGE_SCHEMA}")


# --- texts as images ------------------------------------------------------------------------------------------


def store(text: bytes) -> bytes:
    size = max(1, -(-len(text) // ROW)) * ROW
    grid = np.frombuffer(text.ljust(size, b"\0"), np.uint8).reshape(-1, ROW, 1)
    return write_pages([grid[k : k + PAGE_ROWS] for k in range(0, len(grid), PAGE_ROWS)], DEFLATE, 2)


def media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(map(len, texts), pa.int64()), pa.array(map(store, texts), pa.binary())], ["doc_id", "n_bytes", "content"])

    return text_bytes(df, "doc_id").mapInArrow(run, "doc_id long, n_bytes long, content binary")


def features(stored: DataFrame) -> DataFrame:
    """Reads the pages of each stored file: digests of the payload and of the file, and a feature string.

    feature: pages, columns, all rows, mean and mean square of the samples in thousandths, and share of 16 equal bins of values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for raw in part.column(2).to_pylist():
                    sha, tail, size, n, rows, hist = hashlib.sha256(), b"", 0, 0, 0, np.zeros(256, np.int64)
                    for n_page, page, error in page_rows(raw):
                        if error:
                            raise TiffError(error)
                        data = page.samples.tobytes()
                        sha.update(data)
                        tail, size, n, rows = (tail + data)[-ROW:], size + len(data), n_page + 1, rows + page.height
                        hist += np.bincount(page.samples.ravel(), minlength=256)
                    value = np.arange(256)
                    bins = ",".join(map(str, (hist.reshape(16, 16).sum(1) * 1000 // size).tolist()))
                    feature = f"{n}x{ROW}x{rows};{int(hist @ value) * 1000 // size};{int(hist @ value**2) * 1000 // size};{bins}"
                    out.append((size, sha.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), feature, n))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages"])

    return stored.select("doc_id", "n_bytes", "content").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long")
