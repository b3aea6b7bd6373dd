"""Log files of lines as a Python data source: batch and stream, cut into splits, with filters applied where lines are read.

A line is fields with tabs between, typed by the schema that the reader is given; \\N is null. A field that doesn't fit its type makes the line malformed: it's
left out, or kept with nulls and the line in the column named by ``corrupt``.

    register(spark)
    spark.read.format("quarry_log").schema("ts timestamp_ntz, user_id long, kind string").load(folder).where("user_id = 7")

Batch: each split is a range of bytes of one file; a line belongs to the split in which it starts, so files of any size are many tasks'. Comparisons of a column with
a value, IN and null tests are taken over by the scan, which drops lines before they are made into rows; what it can't take, Spark filters as ever.
Stream: an offset is the bytes of whole lines of each file, so files may grow and be added, a line half written waits, and a restart goes on where
its checkpoint says. Files are found and read through pyarrow, by any URI that it knows, on driver and executors alike.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME, NULL = "quarry_log", "\\N"
#: Bytes of a split, of a read, and lines of a batch.
SPLIT, READ, BATCH = 64 << 20, 1 << 20, 10_000
COMPARE = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def files(uri: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Files of a folder, or the one named, in order of name; hidden ones and Spark's marks aside."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[:1] not in "._"]
    return system, sorted(found, key=lambda f: f.path)


def cut(path: str, start: int, end: int, size: int) -> list[Split]:
    return [Split(path, at, min(at + size, end)) for at in range(start, end, size)]


def lines(system: fs.FileSystem, split: Split) -> Iterator[bytes]:
    """Lines that start within the split; the last may end after it."""
    with system.open_input_file(split.path) as f:
        at = split.start
        if at:  # the line before may end right here
            f.seek(at - 1)
            at -= 1
        held, skip = b"", bool(split.start)
        while at < split.end or held:
            piece = f.read(READ)
            parts = (held + piece).split(b"\n")
            if not piece:
                if held and not skip and at < split.end:
                    yield held
                return
            held = parts.pop()
            for line in parts:
                if skip:
                    skip = False
                elif at >= split.end:
                    return
                else:
                    yield line
                at += len(line) + 1
            if at >= split.end and not skip:
                return


class Lines:
    """What batch and stream readers share: lines to rows, and filters on them."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.uri, self.corrupt, self.size = options["path"], options.get("corrupt"), int(options.get("split", SPLIT))
        self.schema, self.kept = to_arrow_schema(schema), []
        if self.size <= 0:
            raise ValueError("split must be positive")
        self.names = [f.name for f in self.schema if f.name != self.corrupt]

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the filters that lines can be held against; yields the others."""
        for f in filters:
            if type(f) in (*COMPARE, In, IsNull, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in self.names:
                self.kept.append(f)
            else:
                yield f

    def passes(self, table: pa.RecordBatch) -> pa.Array:
        ok = pa.array([True] * table.num_rows, pa.bool_())
        for f in self.kept:
            column = table.column(f.attribute[0])
            if isinstance(f, IsNull):
                test = pc.is_null(column)
            elif isinstance(f, IsNotNull):
                test = pc.is_valid(column)
            elif isinstance(f, EqualNullSafe) and f.value is None:
                test = pc.is_null(column)
            elif isinstance(f, In):
                test = pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type), skip_nulls=True)
            else:
                name = {operator.eq: "equal", operator.gt: "greater", operator.ge: "greater_equal", operator.lt: "less", operator.le: "less_equal"}[COMPARE[type(f)]]
                test = pc.call_function(name, [column, pa.scalar(f.value, column.type)])
            ok = pc.and_(ok, pc.fill_null(test, False))
        return ok

    def batch(self, rows: list[bytes]) -> pa.RecordBatch:
        fields = [r.decode("utf-8", "replace").removesuffix("\r").split("\t") for r in rows]
        bad = [len(f) != len(self.names) for f in fields]
        columns = {}
        for k, name in enumerate(self.names):
            texts = [None if b or f[k] == NULL else f[k] for f, b in zip(fields, bad, strict=True)]
            columns[name] = self.typed(texts, self.schema.field(name).type, bad)
        for name in columns:  # a line is malformed as a whole
            columns[name] = pc.if_else(pa.array(bad), pa.scalar(None, columns[name].type), columns[name])
        if self.corrupt:
            columns[self.corrupt] = pa.array([r.decode("utf-8", "replace") if b else None for r, b in zip(rows, bad, strict=True)], pa.string())
        out = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in self.schema], schema=self.schema)
        if not self.corrupt:
            out = out.filter(pa.array([not b for b in bad]))
        return out.filter(self.passes(out))

    def typed(self, texts: list[str | None], kind: pa.DataType, bad: list[bool]) -> pa.Array:
        """The column's values. Where one doesn't fit, each is tried, and those lines are marked in ``bad``."""
        try:
            return pa.array(texts, pa.string()).cast(kind)
        except pa.ArrowInvalid:
            out = []
            for k, t in enumerate(texts):
                try:
                    out.append(pa.array([t], pa.string()).cast(kind)[0].as_py())
                except pa.ArrowInvalid:
                    out.append(None)
                    bad[k] = True
            return pa.array(out, kind)

    def rows(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), None)
        held: list[bytes] = []
        for line in lines(system, split):
            held.append(line)
            if len(held) == BATCH:
                yield self.batch(held)
                held = []
        if held:
            yield self.batch(held)


class LogReader(Lines, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from self.take(filters)

    def partitions(self) -> list[Split]:
        return [s for f in files(self.uri)[1] for s in cut(f.path, 0, f.size, self.size)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class LogStreamReader(Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of whole lines of each file."""
        system, found = files(self.uri)
        return {f.path: end for f in found if (end := self.whole(system, f))}

    def whole(self, system: fs.FileSystem, info: fs.FileInfo) -> int:
        with system.open_input_file(info.path) as f:
            end = info.size
            while end:
                start = max(end - READ, 0)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [s for path, to in sorted(end.items()) for s in cut(path, start.get(path, 0), to, self.size)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
