"""The flow of a restore: pieces of streams in order, hashed or written as they pass.

The pieces of a stream come to one task, sorted by place (Spark spills what doesn't fit), and stream through it: a batch of pieces is held at
a time, however long the stream is. A stream is one task's work, as its digest and its file are made from start to end.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import chunking
from granary.functions.blake3 import digest_column
from granary.operators import integrity
from granary.session import importable

RESTORED = "stream string, size long, digest string, pieces long, problem string, path string"


def opened_pieces(refs: DataFrame, stored: DataFrame, key: Column, opened: Callable = chunking.try_plain) -> DataFrame:
    """(stream, sequence, size, hash, algo, data) of refs (stream, sequence, size, hash, algo) from stored (object_key, envelope, algorithm); what can't be opened has no data."""
    df = refs.withColumn("object_key", integrity.object_key(F.col("hash"))).join(stored.select("object_key", "envelope", "algorithm"), "object_key", "left")
    plain = opened(F.col("envelope"), F.col("algorithm"), key, F.col("hash").cast("binary"))
    return df.select("stream", F.col("sequence").cast("long").alias("sequence"), "size", "hash", "algo", plain.alias("data"))


def restored(pieces: DataFrame, folder: str | None = None) -> DataFrame:
    """(stream, size, digest, pieces, problem, path) of pieces (stream, sequence, size, hash, algo, data); digest is the stream's SHA-256.

    Sequences must run from 0 without gap or repeat, each piece must be there with its size and content id; the first piece of which that doesn't hold is named in
    `problem`, and the stream has no digest. With a folder (shared by all executors) a stream is written to a file aside, which takes its name, the
    SHA-256 of the stream's, at the end; a stream with a problem leaves no file."""
    importable(pieces.sparkSession)
    given = pieces.select("stream", F.col("sequence").cast("long").alias("sequence"), F.col("size").cast("long").alias("size"), "hash", "algo", "data")
    dealt = given.repartition("stream").sortWithinPartitions("stream", "sequence")
    root = folder.removeprefix("file://") if folder else None

    class Stream:
        def __init__(self, name: str | None):
            self.name, self.size, self.count, self.problem, self.sha, self.file = name, 0, 0, None, hashlib.sha256(), None
            if root:
                os.makedirs(root, exist_ok=True)
                self.path = f"{root}/{hashlib.sha256((name or '').encode()).hexdigest()}"
                self.aside = f"{self.path}.{uuid.uuid4().hex}.tmp"
                self.file = open(self.aside, "wb")  # noqa: SIM115

        def add(self, sequence: int, size: int, data: bytes | None, right: bool) -> None:
            if self.problem is None:
                wrong = "gap" if sequence > self.count else "repeated" if sequence < self.count else "unreadable" if data is None else "size" if len(data) != size else None if right else "digest"
                self.problem = wrong and f"{wrong} at {sequence}"
            if self.problem is None:
                self.sha.update(data)
                self.size += len(data)
                if self.file:
                    self.file.write(data)
            self.count += 1

        def end(self) -> tuple:
            if self.file:
                self.file.flush()
                os.fsync(self.file.fileno())
                self.file.close()
                os.remove(self.aside) if self.problem else os.replace(self.aside, self.path)
            good = self.problem is None
            return self.name, self.size, self.sha.hexdigest() if good else None, self.count, self.problem, self.path if self.file and good else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            data = batch.column(5)
            blake = digest_column(data) if "blake3" in batch.column(4).to_pylist() else None
            for i, (name, sequence, size, digest, algo) in enumerate(zip(*[c.to_pylist() for c in batch.columns[:5]], strict=True)):
                if now is None or now.name != name:
                    if now is not None:
                        done.append(now.end())
                    now = Stream(name)
                piece = data[i].as_py()
                found = None if piece is None else blake[i] if algo == "blake3" else hashlib.sha256(piece).hexdigest()
                now.add(sequence, size, piece, found == digest)
            yield _rows(done)
        yield _rows([now.end()] if now is not None else [])

    return dealt.mapInArrow(work, RESTORED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["stream", "size", "digest", "pieces", "problem", "path"])
