"""A change-capture source: records after a position, as batch or stream.

The log is a folder of JSON-lines files named by the first position they hold (`<position>.jsonl`, zero-padded or not), each line
with `position` (a number), `time`, `operation`, `key` and `payload`. A stream's offset is the last position read, kept in the checkpoint, so a
restarted query goes on where it was: that is the resume point. Files are read by the executors; the driver lists names and reads the end of the newest file.

    spark.dataSource.register(ChangeLog)
    spark.readStream.format("change_log").option("path", folder).option("after", "0").load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "position bigint, time timestamp, operation string, key string, payload string"


class Span(InputPartition):
    """Records with after < position <= to in one file."""

    def __init__(self, path: str, after: int, to: int):
        self.path, self.after, self.to = path, after, to


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    system, root = _system(path)
    infos = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((int(i.base_name.removesuffix(".jsonl")), i.path) for i in infos if i.base_name.endswith(".jsonl"))


def _lines(path: str, file: str) -> Iterator[dict]:
    system, _ = _system(path)
    with system.open_input_stream(file) as f:
        for line in f.readall().split(b"\n"):
            if line.strip():
                yield json.loads(line)


def _last_position(path: str, file: str) -> int | None:
    """Position of the last whole line, read from the end of the file."""
    system, _ = _system(path)
    with system.open_input_file(file) as f:
        size, width = f.size(), 1 << 16
        while True:
            at = max(0, size - width)
            lines = f.read_at(size - at, at).split(b"\n")
            for line in reversed(lines[0 if at == 0 else 1 :]):
                try:
                    return json.loads(line)["position"]
                except ValueError:  # blank, or still being written
                    continue
            if at == 0:
                return None
            width *= 4


def _spans(path: str, after: int, to: int) -> list[Span]:
    """Files that can hold such records: a file ends where the next one begins."""
    files = _files(path)
    nexts = [p for p, _ in files[1:]] + [None]
    return [Span(f, after, to) for (first, f), n in zip(files, nexts, strict=True) if first <= to and (n is None or n > after + 1)]


def _rows(path: str, span: Span) -> Iterator[tuple]:
    for r in _lines(path, span.path):
        if span.after < r["position"] <= span.to:
            yield r["position"], datetime.fromisoformat(r["time"]) if r.get("time") else None, r.get("operation"), r.get("key"), json.dumps(r.get("payload"))


class Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.after, self.to = options["path"], int(options.get("after", 0)), int(options.get("to", 2**62))

    def partitions(self) -> list[Span]:
        return _spans(self.path, self.after, self.to) or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(self.path, partition) if partition.path else iter(())


class Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.after = options["path"], int(options.get("after", 0))

    def initialOffset(self) -> dict:
        return {"position": self.after}

    def latestOffset(self) -> dict:
        """The last position of the newest file; the log only grows there."""
        files = _files(self.path)
        if not files:
            return {"position": self.after}
        last = _last_position(self.path, files[-1][1])
        return {"position": max(self.after, files[-1][0] - 1 if last is None else last)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return _spans(self.path, start["position"], end["position"])

    def read(self, partition: Span) -> Iterator[tuple]:
        return _rows(self.path, partition)


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Batch:
        return Batch(self.options)

    def streamReader(self, schema) -> Stream:
        return Stream(self.options)
