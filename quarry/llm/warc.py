"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

``parse_records`` reads WARC/1.0 and 1.1 records from bytes, whole-file or per-record gzip included.
``derive`` turns a response record into two records that name it in WARC-Refers-To (with its URI and date),
name each other in WARC-Concurrent-To, keep the source's HTTP status line and headers and its digests as
metadata fields, and carry digests of their own. Record ids are UUIDs of the source id and the record's
kind, so a second attempt makes the same records. The conversion's text is the page's visible text, a block a
line (all blocks: the main text alone is another operator's matter).

All transfer codings, then all content codings are undone, the last named first, over repeated headers too; what can't be undone, isn't
HTML or text, or isn't a response gives no conversion but an ``error``. So does a record whose block, inflated or not, is over INFLATED bytes, or whose
headers are over HEADERS: its bytes are passed over and the next record is read. One
record's error is its own: only a content that can't be cut into records any further ends. Text is decoded by its byte-order mark, else the charset
of the Content-Type header, else that named in its first bytes (meta or XML declaration), else as UTF-8; a charset unknown here counts as none. ``page_responses`` makes response
records of rows of pages. ``pack`` groups derived records into WARC files of one gzip member a record, files as
binary cells of a table.

Rows: a null html is an empty body and a null url has no target URI; their conversion is empty. Repeated rows
make repeated records with one id; null and repeated page ids stay. Very long pages are derived whole, and compressed contents are
read record by record. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.html import blocks

#: Capture time of page_id 0 in test tables; each later page one second more. Name space of record ids.
FIRST, SPACE = datetime(2024, 1, 1, tzinfo=UTC), uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
FILE_BYTES = 8 << 20
#: Bytes of one record or body, inflated, at most (a cell of a Spark row holds 2 GB), of a record's headers, and of a step in inflating.
INFLATED, HEADERS, STEP = 256 << 20, 1 << 20, 64 << 10
HEX, BLANK = re.compile(rb"[0-9a-fA-F]{1,15}[ \t]*\Z"), re.compile(rb"\r?\n\r?\n")
TEXTUAL = re.compile(r"\s*(text/|application/(xhtml\+xml|xml))", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
#: Where a page names its charset itself, within so many of its first bytes.
NAMED, AHEAD = re.compile(rb"<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)|<\?xml\b[^>]*?\bencoding\s*=\s*[\"']([\w.:-]+)", re.I), 1024
#: Byte-order marks and their charsets, the longer ones first.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
LENGTH = re.compile(rb"\r\ncontent-length[ \t]*:[ \t]*([0-9]{1,15})[ \t]*\r\n", re.I)


class WarcError(ValueError):
    pass


@dataclass
class Record:
    headers: list[tuple[str, str]]
    block: bytes
    problem: str | None = None  # why the block wasn't read

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        lines = "".join(f"{k}: {v}\r\n" for k, v in [*self.headers, ("Content-Length", str(len(self.block)))])
        return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def fold(raw: bytes) -> list[tuple[str, str]]:
    """Header lines; a line that starts with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n" if b"\r\n" in raw else "\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def inflate(raw: bytes, wbits: int) -> Iterator[bytes]:
    """Pieces of one deflate stream or of all gzip members, never much more than STEP at once."""
    flow, last = zlib.decompressobj(wbits), len(raw)
    at = 0
    while at < last:
        piece = raw[at : at + STEP]
        at += len(piece)
        while piece:
            try:
                yield flow.decompress(piece, STEP)
            except zlib.error as e:
                raise WarcError(f"inflating: {e}") from e
            piece = flow.unconsumed_tail
            if flow.eof:
                at -= len(flow.unused_data)
                break
        if flow.eof:
            if wbits < 31 or not raw[at:last].strip(b"\0"):
                return
            flow = zlib.decompressobj(wbits)
    if not flow.eof:
        raise WarcError("inflating: cut off")


def inflated(raw: bytes, wbits: int) -> bytes:
    out = bytearray()
    for piece in inflate(raw, wbits):
        out += piece
        if len(out) > INFLATED:
            raise WarcError(f"inflates to more than {INFLATED} bytes")
    return bytes(out)


class Source:
    """A content's bytes from its start on, inflated only as far as they are asked for."""

    def __init__(self, raw: bytes):
        self.pieces = inflate(raw, 31) if raw[:2] == b"\x1f\x8b" else iter((raw,))
        self.held, self.done = bytearray(), 0

    def has(self, n: int) -> bool:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def take(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.done += n
        return out

    def skip(self, n: int) -> bool:
        """Passes over n bytes without holding them; whether there were so many."""
        while n:
            if not self.held and not self.has(1):
                return False
            n -= len(self.take(min(n, len(self.held), STEP)))
        return True

    def skip_headers(self) -> int | None:
        """Passes over headers that are too long, up to their end; the length of the block that they name."""
        size, kept = None, b""
        while self.has(1):
            part = kept + self.take(STEP)
            end = part.find(b"\r\n\r\n")
            told = LENGTH.search(part if end < 0 else part[: end + 4])
            size = int(told[1]) if told and size is None else size
            if end >= 0:
                self.held[:0] = part[end + 4 :]
                return size
            kept = part[-64:]
        return None

    def find(self, what: bytes) -> int:
        """Where it comes next; negative if not within HEADERS bytes."""
        seen = 0
        while (at := self.held.find(what, max(0, seen - len(what)), HEADERS)) < 0:
            seen = len(self.held)
            if seen >= HEADERS or not self.has(seen + 1):
                break
        return at


def parse_records(raw: bytes) -> Iterator[Record]:
    source = Source(raw)
    while source.has(1):
        if source.has(2) and source.held[:2] == b"\r\n":
            source.take(2)
            continue
        if not source.has(5) or source.held[:5] != b"WARC/":
            raise WarcError(f"no record at byte {source.done}")
        end = source.find(b"\r\n\r\n")
        if end < 0 and len(source.held) >= HEADERS:
            fields = fold(bytes(source.held[:HEADERS]).partition(b"\r\n")[2].rpartition(b"\n")[0])
            size = source.skip_headers()
            if size is None:
                raise WarcError("headers are cut off or name no length")
            whole = source.skip(size)
            yield Record([(k, v) for k, v in fields if k.lower() != "content-length"], b"", f"headers of more than {HEADERS} bytes")
            if not whole:
                raise WarcError("a block is cut off")
            continue
        if end < 0:
            raise WarcError("headers are cut off")
        fields = fold(source.take(end + 4)[:-4].partition(b"\r\n")[2])
        sizes = [v for k, v in fields if k.lower() == "content-length" and v.isascii() and v.isdigit() and len(v) < 16]
        if not sizes:
            raise WarcError("no Content-Length")
        size = int(sizes[0])
        if size > INFLATED:
            whole = source.skip(size)
            yield Record([(k, v) for k, v in fields if k.lower() != "content-length"], b"", f"a block of more than {INFLATED} bytes")
            if not whole:
                raise WarcError("a block is cut off")
            continue
        if not source.has(size):
            raise WarcError("a block is cut off")
        yield Record([(k, v) for k, v in fields if k.lower() != "content-length"], source.take(size))


def response(url: str | None, when: datetime, body: bytes, http: list[tuple[str, str]] | None = None, status: str = "HTTP/1.1 200 OK") -> Record:
    http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))] if http is None else http
    block = f"{status}\r\n{''.join(f'{k}: {v}\r\n' for k, v in http)}\r\n".encode() + body
    stamp = when.strftime("%Y-%m-%dT%H:%M:%SZ")
    name = uuid.uuid5(SPACE, f"response|{url}|{stamp}|{digest(block)}")
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", stamp)]
    headers += [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
    return Record(headers, block)


def unchunk(body: bytes) -> bytes:
    """The chunks' data. A size is hexadecimal digits alone, extensions after a semicolon aside."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + HEADERS)
        if end < 0:
            raise WarcError("chunks are cut off")
        said = body[at:end].split(b";", 1)[0]
        if not HEX.match(said):
            raise WarcError("bad chunk")
        size = int(said, 16)
        if not size:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise WarcError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise WarcError("bad chunk")
        at += 2


def payload(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body as the server sent them."""
    gap = BLANK.search(block)
    if not gap or not block.startswith(b"HTTP/"):
        raise WarcError("not an HTTP response")
    status, _, rest = block[: gap.start()].partition(b"\n")
    return status.rstrip(b"\r").decode("utf-8", "replace"), fold(rest), block[gap.end() :]


def codings(http: list[tuple[str, str]], name: str) -> list[str]:
    """All codings of all headers of this name, in the order in which they were applied."""
    return [c for k, v in http if k.lower() == name for c in (x.strip().lower() for x in v.split(",")) if c not in ("", "identity")]


def decoded(body: bytes, coding: str) -> bytes:
    if coding == "chunked":
        return unchunk(body)
    if coding in ("gzip", "x-gzip"):
        return inflated(body, 31)
    if coding == "deflate":
        return inflated(body, 15 if body[:1] == b"\x78" else -15)
    raise WarcError(f"coding {coding}")


def as_text(kind: str, body: bytes) -> str:
    """The body as text, see the module's docstring for the order of charsets."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    said, own = CHARSET.search(kind), NAMED.search(body[:AHEAD]) if not kind.lower().lstrip().startswith("text/plain") else None
    names = [said[1]] if said else []
    if own:
        name = (own[1] or own[2]).decode("ascii", "replace")
        names.append("utf-8" if name.lower().startswith("utf-16") else name)  # it was read byte by byte, so it can't be that
    for name in names:
        try:
            return body.decode(name, "replace")
        except LookupError:  # no such charset
            continue
        except ValueError as e:  # one that can't decode this, as idna
            raise WarcError(f"charset {name}: {e}") from e
    return body.decode("utf-8", "replace")


def text_of(http: list[tuple[str, str]], body: bytes) -> str:
    kind = next((v for k, v in reversed(http) if k.lower() == "content-type"), "text/html")
    if not TEXTUAL.match(kind):
        raise WarcError(f"no text in {kind.split(';')[0]}")
    for coding in [*reversed(codings(http, "transfer-encoding")), *reversed(codings(http, "content-encoding"))]:
        body = decoded(body, coding)
    page = as_text(kind, body)
    return page if kind.lower().lstrip().startswith("text/plain") else "\n".join(b.text for b in blocks(page))


def derive(source: Record) -> tuple[list[Record], str | None]:
    """The metadata record, then the conversion record if there is a text; and why there is none."""
    if source.get("WARC-Type") != "response":
        raise WarcError(f"a record of type {source.get('WARC-Type')}")
    if source.problem:
        raise WarcError(source.problem)
    own, uri, when = source.get("WARC-Record-ID"), source.get("WARC-Target-URI"), source.get("WARC-Date")
    name = lambda kind: f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}|{own}')}>"
    refers = [("WARC-Date", when or ""), ("WARC-Refers-To", own or "")]
    refers += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)] if uri else []
    refers += [("WARC-Refers-To-Date", when)] if when else []
    status, http, body = payload(source.block)
    error, text = None, b""
    try:
        text = text_of(http, body).encode("utf-8", "surrogatepass")
    except WarcError as e:
        error = str(e)
    fields = [("source-record-id", own), ("source-payload-digest", source.get("WARC-Payload-Digest") or digest(body)), ("source-block-digest", source.get("WARC-Block-Digest") or digest(source.block))]
    fields += [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http)]
    fields += [(f"source-{k.lower()}", v) for k, v in source.headers if k.lower() in ("warc-ip-address", "warc-warcinfo-id", "warc-truncated", "warc-identified-payload-type")]
    fields += [("conversion-error", error)] if error else [("conversion-record-id", name("conversion"))]
    block = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    out = [Record([("WARC-Type", "metadata"), ("WARC-Record-ID", name("metadata")), *refers, *[("WARC-Concurrent-To", name("conversion"))] * (not error), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(block))], block)]
    if not error:
        out.append(Record([("WARC-Type", "conversion"), ("WARC-Record-ID", name("conversion")), *refers, ("WARC-Concurrent-To", name("metadata")), ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Payload-Digest", digest(text)), ("WARC-Block-Digest", digest(text))], text))
    return out, error


def page_responses(df: DataFrame) -> DataFrame:
    """page_id, url and the response record of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [response(u, FIRST + timedelta(seconds=(i or 0) % 10**9), h).to_bytes() for i, u, h in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["page_id", "url", "warc"])

    html = F.coalesce("html", F.lit("")).cast("binary")
    return df.select("page_id", "url", html.alias("html")).mapInArrow(run, "page_id long, url string, warc binary")


FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "block_digest": "WARC-Block-Digest"}


def derivatives(df: DataFrame, key: str = "page_id", content: str = "warc") -> DataFrame:
    """A row for each derived record: the key, its named fields, the source's payload digest, the record and any error.

    Content with several records gives rows for each of its responses; other records give none. A response that isn't
    HTTP gives one row with the error, its id as refers_to, its URI and date. Where content can't be parsed any
    further, a row has the error alone.
    """
    columns = [*FIELDS, "source_payload_digest", "content_length", "n_chars", "record", "error"]
    kinds = [pa.string()] * (len(FIELDS) + 1) + [pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def rows(raw: bytes | None) -> Iterator[tuple]:
        try:
            for source in parse_records(raw or b""):
                if source.get("WARC-Type") != "response":
                    continue
                try:
                    made, error = derive(source)
                    kept = source.get("WARC-Payload-Digest") or digest(payload(source.block)[2])
                except WarcError as e:  # of this response alone
                    own = {k: source.get(h) for k, h in (("refers_to", "WARC-Record-ID"), ("target_uri", "WARC-Target-URI"), ("warc_date", "WARC-Date"))}
                    yield (*map(own.get, FIELDS), source.get("WARC-Payload-Digest"), *[None] * 3, str(e))
                    continue
                for r in made:
                    yield (*map(r.get, FIELDS.values()), kept, len(r.block), len(r.block.decode("utf-8", "replace")), r.to_bytes(), error)
        except WarcError as e:
            yield (*[None] * (len(columns) - 1), str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = [(k, row) for k, raw in enumerate(part.column(1).to_pylist()) for row in rows(raw)]
                cells = list(zip(*(row for _, row in got), strict=True)) or [()] * len(columns)
                keys = part.column(0).take(pa.array([k for k, _ in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(cells, kinds, strict=True))], [key, *columns])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {'binary' if c == 'record' else 'long' if t == pa.int64() else 'string'}" for c, t in zip(columns, kinds, strict=True))
    return df.select(key, content).mapInArrow(run, schema)


def pack(derived: DataFrame) -> DataFrame:
    """WARC files of a partition's records, one gzip member each: path, n_records, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"derived-{part:06d}-{k:06d}.warc.gz"]), pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["path", "n_records", "content"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(gzip.compress(raw, 6, mtime=0))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield file()
                    k, held, size = k + 1, [], 0
        if held:
            yield file()

    return derived.where("record IS NOT NULL").select("record").mapInArrow(run, "path string, n_records long, content binary")


def report(df: DataFrame) -> DataFrame:
    """The derived records of all pages, each record as a digest."""
    made = derivatives(page_responses(df))
    return made.select("page_id", *FIELDS, "source_payload_digest", "content_length", "n_chars", F.sha2("record", 256).alias("record_sha256"), "error")
