"""Spark's reader of commit logs in large files: spark.read.format("commit_log"), and readStream.

A file is the output of `git log -p` with a record separator ahead of each commit (--format=%x1e%H%x00%at%x00%s, or with
%x00%P before the subject, which tells merges). It is cut into ranges of bytes; a range holds the commits whose separator lies in it, and reads on
behind its end to finish the last one. A commit is read piece by piece and kept up to a number of bytes, so a larger one is never held.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

SEPARATOR = b"\x1e"
SCHEMA = "file string, at bigint, sha string, ts bigint, merge boolean, subject string, patch string, truncated boolean"
#: Bytes of a range, of a commit, and read at once.
SPLIT, LONGEST, PIECE = 128 << 20, 8 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, size) of a file or of all files of a folder, in order of their names; hidden ones left out."""
    store, where = opened(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(where, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    ahead = path[: len(path) - len(where)] if path.endswith(where) else ""
    return sorted((ahead + f.path, f.size) for f in found)


def ranges(file: str, low: int, high: int, split: int) -> list[Range]:
    return [Range(file, at, min(at + split, high)) for at in range(low, high, split)]


def records(source, low: int, high: int, longest: int, piece: int = PIECE) -> Iterator[tuple[int, bytes, bool]]:
    """(place, bytes, cut) of each record whose separator lies in [low, high); the bytes are what follows it, `longest` of them at most."""
    source.seek(low)
    place, held, size, at = -1, [], 0, low
    while True:
        data = source.read(piece)
        begin = 0
        while data:
            sep = data.find(SEPARATOR, begin)
            part = data[begin : sep if sep >= 0 else len(data)]
            if place >= 0:
                if size < longest:
                    held.append(part[: longest - size])
                size += len(part)
            if sep < 0:
                break
            if place >= 0:
                yield place, b"".join(held), size > longest
            if at + sep >= high:
                return
            place, held, size, begin = at + sep, [], 0, sep + 1
        if not data:
            break
        at += len(data)
        if place < 0 and at >= high:
            return
    if place >= 0:
        yield place, b"".join(held), size > longest


def parsed(data: bytes) -> tuple | None:
    """(sha, ts, merge, subject, patch) of a record, None if it has no such head; merge is None where the log tells no parents."""
    head, _, patch = data.partition(b"\n")
    parts = head.decode("utf-8", "replace").split("\0")
    if len(parts) < 3 or len(parts[0]) < 7:
        return None
    known = len(parts) > 3
    ts = int(parts[1]) if parts[1].lstrip("-").isdigit() else None
    text = patch.decode("utf-8", "ignore").removeprefix("\n")
    return parts[0], ts, len(parts[2].split()) > 1 if known else None, "\0".join(parts[3 if known else 2 :]), text


class _Rows:
    """What both readers do with a range."""

    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("commit_log needs a path")
        number = lambda name, default: int(options.get(name, default))
        self.split, self.longest, self.most = number("splitBytes", SPLIT), number("longestCommit", LONGEST), number("mostOfRange", -1)
        self.merges = options.get("merges", "true").lower() != "false"

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, where = opened(part.file)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
        types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]
        out, size, told = [], 0, 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        with store.open_input_file(where) as source:
            for at, data, cut in records(source, part.low, part.high, self.longest):
                found = parsed(data)
                if found is None or (found[2] and not self.merges):
                    continue
                out.append((part.file, at, *found, cut))
                size, told = size + len(data), told + 1
                if size > 16 << 20 or len(out) >= 4096:
                    yield batch()
                    out, size = [], 0
                if told == self.most:
                    break
        if out:
            yield batch()


class LogReader(_Rows, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """merge = false is seen to as records are read."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("merge",) and f.value is False:
                self.only_single = True
            yield f

    only_single = False

    def partitions(self) -> list[Range]:
        return [r for file, size in files_of(self.path) for r in ranges(file, 0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.only_single:
            self.merges = False
        return self.rows(partition) if partition.file else iter(())


class LogStream(_Rows, DataSourceStreamReader):
    """Offsets are the bytes read of each file. The newest commit of a file waits for the next separator, as it may still be written."""

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        ends = {}
        for file, size in files_of(self.path):
            store, where = opened(file)
            with store.open_input_file(where) as source:
                at, end = size, 0
                while at > 0 and not end:
                    low = max(0, at - PIECE)
                    source.seek(low)
                    end = low + source.read(at - low).rfind(SEPARATOR)
                    end, at = (end, 0) if end >= low else (0, low)
                ends[file] = end
        return {"files": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return [r for file, high in after.items() if high > before.get(file, 0) for r in ranges(file, before.get(file, 0), high, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class CommitLog(DataSource):
    """Options: path, splitBytes, longestCommit, mostOfRange (commits of a range at most; what a limit needs), merges (false: left out as they are read)."""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes "commit_log" known to a session. Spark hands filters to Python readers only where this setting is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommitLog)


def read_large_log(spark: SparkSession, path: str, skip: int = 0, limit: int | None = None, merges: bool = True, **options: int) -> DataFrame:
    """SCHEMA rows of a log, by several tasks: without its `skip` first commits and `limit` of the others at most, merges left out before they are counted.

    With a limit no range gives more than skip + limit commits, so that the rest of a long log is not parsed. Rows have no order beyond `file` and `at`.
    """
    register(spark)
    reader = spark.read.format("commit_log").option("merges", str(merges).lower()).options(**{k: str(v) for k, v in options.items()})
    if limit is not None:
        reader = reader.option("mostOfRange", skip + limit)
    found = reader.load(path)
    return found if limit is None and not skip else found.orderBy("file", "at").offset(skip).limit(limit if limit is not None else 2**31 - 1)
