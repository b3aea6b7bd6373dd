"""Token files: ids under a canonical length-limited Huffman code of global counts.

A file holds the documents of one range of doc_id, in order:

    magic b"QHF2", then little-endian u32: alphabet size, block symbols, documents, those of null id, blocks; u64: symbols, bits
    code lengths      one byte for each id of the alphabet
    document ids      i64 for each document; those of null id come first and have 0 here
    document lengths  u32 for each document
    checkpoints       u64 for each block: the bit at which it starts
    code bits         most significant bit first, in 32-bit words

The code is canonical, so its lengths say all of it, and every file decodes alone. Each block of BLOCK
symbols starts at its checkpoint and decodes without the others: the table-driven decoder steps through all
blocks of a file at once. Files are binary cells of a Parquet table in the shared folder (path, content),
whose commit protocol keeps a lost executor or a second attempt from leaving half a file. Everything that ``read_files``
returns comes from the content; the path gives the order.

The ids are those of the tokenizers library for the whole text; ``pieces`` asks it once for each distinct piece, where
the tokenizer file lets pieces be told apart, and else gives it whole texts.

Rows: a null text counts as empty and yields the end id alone. Rows with a null doc_id come first; rows with
one doc_id are in the order of a hash of their ids, and equal rows are dealt over tasks like any others. Texts of any length stay whole: a file
takes them until it has FILE_IDS ids. Other columns are not read. An empty table makes no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.llm.common import Workspace, text_bytes
from quarry.llm.pieces import PART, Encoder

MAGIC, HEAD = b"QHF2", "<4s5I2Q"
#: Longest code in bits, symbols of a block, ids of a file (a document is never split), and ids that a writing task takes at most, about.
LIMIT, BLOCK, FILE_IDS, TASK_IDS = 18, 256, 1_000_000, 32_000_000
#: Ids that the writer handles at once: a multiple of BLOCK.
STEP = 64 * BLOCK
END_ID = 1
UNZIP = zstandard.ZstdDecompressor()


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code under ``limit`` bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    # from_leaf[k]: of level k's merged list, which items are leaves; packages pair up the level below.
    levels, packages = [], np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(weights))
        both = both[order]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * (len(used) - 1)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.int64)
    code, last = 0, 0
    for k in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == k)
        code <<= k - last
        last = k
        codes[ids] = code + np.arange(len(ids))
        code += len(ids)
    return codes


def write_file(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray, doc_ids: list[int | None] | None = None) -> bytes:
    """doc_ids: nulls first; by default the documents are numbered."""
    doc_ids = list(range(len(docs))) if doc_ids is None else doc_ids
    unnamed = sum(d is None for d in doc_ids)
    if None in doc_ids[unnamed:]:
        raise ValueError("documents of null id come first")
    ids = np.concatenate(docs) if docs else np.empty(0, np.int64)
    words, marks, bits = np.zeros(len(ids) * int(lengths.max(initial=0)) // 32 + 2, np.uint64), [], 0
    for k in range(0, len(ids), STEP):  # steps that stay in the processor's cache
        part = ids[k : k + STEP]
        size = lengths[part].astype(np.int64)
        at = np.cumsum(size)
        total = int(at[-1])
        at += bits - size
        marks.append(at[::BLOCK])
        # A code starts in 32-bit word at >> 5 and may run into the next; the parts don't overlap, so sums are unions.
        word = at >> 5
        wide = codes[part].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[start]] |= np.bitwise_or.reduceat(wide >> np.uint64(32), start)
        words[word[start] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), start)
        bits += total
    marks = np.concatenate(marks or [np.empty(0, np.int64)]).astype("<u8")
    head = struct.pack(HEAD, MAGIC, len(lengths), BLOCK, len(docs), unnamed, len(marks), len(ids), bits)
    named = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return b"".join([head, lengths.astype(np.uint8).tobytes(), named, np.array([len(d) for d in docs], "<u4").tobytes(), marks.tobytes(), words[: (bits + 31) // 32 + 1].astype(">u4").tobytes()])


@lru_cache(2)
def decode_table(lengths: bytes) -> tuple[int, np.ndarray]:
    """Width, and for each run of so many bits: id << 8 | length of the code that it starts with."""
    size = np.frombuffer(lengths, np.uint8)
    width = max(1, int(size.max(initial=1)))
    table = np.zeros(1 << width, np.uint32)
    used = np.flatnonzero(size)
    used = used[np.argsort(size[used], kind="stable")]  # by length, then id: as the codes run
    fill = np.repeat((used << 8 | size[used]).astype(np.uint32), 1 << (width - size[used].astype(np.int64)))
    table[: len(fill)] = fill
    return width, table


def read_ids(raw: bytes) -> list[int | None]:
    """The documents' ids."""
    _, alphabet, _, n_docs, unnamed, *_ = struct.unpack_from(HEAD, raw)
    return [None] * unnamed + np.frombuffer(raw, "<i8", n_docs, struct.calcsize(HEAD) + alphabet)[unnamed:].tolist()


def read_file(raw: bytes, blocks: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """The documents' lengths, and the ids of the chosen blocks (all of them by default)."""
    magic, alphabet, block, n_docs, _, n_blocks, n, bits = struct.unpack_from(HEAD, raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(HEAD)
    width, table = decode_table(raw[at : at + alphabet])
    at += alphabet + 8 * n_docs
    docs = np.frombuffer(raw, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    marks = np.frombuffer(raw, "<u8", n_blocks, at).astype(np.int64)[blocks]
    words = np.frombuffer(raw, ">u4", offset=at + 8 * n_blocks).astype(np.uint64)
    words = np.r_[words, np.zeros(2, np.uint64)]
    pairs = words[:-1] << np.uint64(32) | words[1:]  # the 64 bits from each word on
    size = np.full(n_blocks, block, np.int64)
    size[-1:] = n - block * (n_blocks - 1)
    size = size[blocks]
    out = np.zeros((block, len(marks)), np.uint32)
    pos, last = marks.copy(), size.min(initial=block)
    mask, back = np.int64((1 << width) - 1), 64 - width
    for k in range(int(size.max(initial=0))):
        live = slice(None) if k < last else np.flatnonzero(size > k)
        p = pos[live]
        window = (pairs[p >> 5] >> (back - (p & 31)).astype(np.uint64)).astype(np.int64) & mask
        got = table[window]
        out[k, live] = got >> 8
        pos[live] = p + (got & 255)
    ids = out.T.ravel()
    return docs, ids if (size == block).all() else ids[(np.arange(block) < size[:, None]).ravel()]


@lru_cache(2)
def load(path: str) -> Encoder:
    """Once for each Python worker: the library and the cache of its ids."""
    return Encoder(path)


def library(path: str) -> tuple[Callable[[str], np.ndarray], int]:
    """The library's encoding of a whole text in one call, and its number of ids."""
    return load(path).whole, load(path).size


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows up to PART bytes, or of one longer text."""
    ends, at = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        yield at, to
        at = to


def encode(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (with the end id; packed) and counts: null, but for each task's last row (ids null), its counts of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(vocabulary)
        zip_, end, total = zstandard.ZstdCompressor(1), END_ID.to_bytes(4, "little"), np.zeros(known.size, np.int64)

        def rows(doc_ids: pa.Array, packed: list[bytes | None], counts: bytes | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(packed, pa.binary()), pa.array([counts] * len(packed), pa.binary())], ["doc_id", "ids", "counts"])

        for batch in batches:
            for at, to in slices(batch.column(1)):
                raw = [ids + end for ids in known.encode(batch.column(1)[at:to].to_pylist())]
                total += np.bincount(np.frombuffer(b"".join(raw), "<u4"), minlength=known.size)
                yield rows(batch.column(0)[at:to], [zip_.compress(halves(r)) for r in raw])
        yield rows(pa.nulls(1, pa.int64()), [None], total.tobytes())

    return text_bytes(df, "doc_id").mapInArrow(run, "doc_id long, ids binary, counts binary")


def halves(raw: bytes) -> bytes:
    """Low halves of all ids, then the high halves if there is one that isn't zero; the first byte tells."""
    half = np.frombuffer(raw, "<u2").reshape(-1, 2)
    return b"\1" + half[:, 0].tobytes() if not half[:, 1].any() else b"\2" + half.T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    raw = UNZIP.decompress(packed)
    low = np.frombuffer(raw, "<u2", offset=1)
    if raw[0] == 1:
        return low
    low, high = low.reshape(2, -1).astype(np.uint32)
    return low | high << np.uint32(16)


def count_ids(encoded: DataFrame, size: int) -> DataFrame:
    """id, count over all documents: the sums of the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                total += np.frombuffer(counts, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "count"])

    counts = encoded.where("counts IS NOT NULL").select("counts")
    return counts.mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_files(encoded: DataFrame, lengths: np.ndarray, partitions: int) -> DataFrame:
    """A row for each token file: path and content; ascending with doc_id through paths. encoded: doc_id, ids, tie and row."""
    size = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        load.cache_clear()  # a reused worker's: all ids are known when files are written
        part, k = TaskContext.get().partitionId(), 0
        sizes = np.frombuffer(size, np.uint8)
        codes = canonical(sizes)
        docs, names, held = [], [], 0

        def file() -> pa.RecordBatch:
            path = f"ids-{part:06d}-{k:06d}.qhf"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([write_file(docs, sizes, codes, names)], pa.large_binary()).cast(pa.binary())], ["path", "content"])

        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(unpack(packed))
                names.append(doc_id)
                held += len(docs[-1])
                if held >= FILE_IDS:
                    yield file()
                    docs, names, held, k = [], [], 0, k + 1
        if docs:
            yield file()

    # Rows of one doc_id are told apart by their ids, and equal rows by their place in the stored table: no id is one task's.
    order = ["doc_id", "tie", "row"]
    ordered = encoded.where("counts IS NULL").select("doc_id", "ids", "tie", "row").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "ids").mapInArrow(run, "path string, content binary")


def decode_files(files: DataFrame, ids: bool = False) -> DataFrame:
    """A row for each document, decoded from content: path, doc_id, at (ids before it in its file), n_tokens, ids_crc32; on request ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, raw = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                names, (lengths, got) = read_ids(raw), read_file(raw)
                ends = np.cumsum(lengths)
                plain = got.astype("<u4").tobytes()
                parts = [plain[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array([path] * len(names)), pa.array(names, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(map(zlib.crc32, parts), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * ids, ["path", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return files.select("path", "content").mapInArrow(run, "path string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def read_files(spark: SparkSession, files: DataFrame, ids: bool = False) -> DataFrame:
    """A row for each document, read from the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32; on request ids."""
    docs = Workspace(spark, "token-docs").put(decode_files(files, ids), "docs")
    # Sums over what was read: of each writing task's files, then before each task, then before each file of it.
    sums = docs.groupBy("path").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.regexp_extract("path", r"^ids-\d+", 0))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each task
    inner = sums.select("path", "part", (F.sum("n").over(Window.partitionBy("part").orderBy("path")) - F.col("n")).alias("inner"))
    first = inner.join(before, "part").select("path", (F.col("inner") + F.col("before")).alias("first"))
    return docs.join(first, "path").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_files(spark: SparkSession, df: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, count, write: the table of token files. Counts go to the driver: at most one for each id of the vocabulary."""
    work = Workspace(spark, "token-files")
    encoded = work.put(encode(df, vocabulary).withColumns({"tie": F.xxhash64("ids"), "row": F.monotonically_increasing_id()}), "ids")
    counts = np.zeros(library(vocabulary)[1], np.int64)
    for row in count_ids(encoded, len(counts)).toLocalIterator():
        counts[row["id"]] = row["count"]
    total = int(counts.sum())
    if not total:
        counts[END_ID] = 1
    # A file's worth for each task of a usual stage; more tasks where they would hold more than TASK_IDS.
    partitions = max(1, -(-total // TASK_IDS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_IDS)))
    files = work.put(write_files(encoded, code_lengths(counts), partitions), "files")
    work.drop(encoded)
    return files
