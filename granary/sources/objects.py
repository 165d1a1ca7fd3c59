"""Objects put if absent: of all writers of a key, in this job or any other, one wins and the others are told.

Two steps. The sink (`DataSourceArrowWriter`) stages a job: each task writes its objects to files of their own below `<root>/.staging/<job>` and lists them
in one more file; the commit messages are the names of these lists, and the commit writes them into one file, under a name it takes at
once. A job that fails before that leaves nothing visible, and its abort removes what it staged. Publishing is a Spark job over the lists: an object gets its
key by a hard link, which the file system makes or refuses as one step. So an object is there whole or not at all, and a repeated or
concurrent attempt finds the link either made of the same file (then it has written it) or of another (then its key was taken).

The root is on a file system with hard links that all executors share. Listings leave out what begins with a dot.

    outcome = put_objects(df, root)   # (object_key, outcome, size, sha256), outcome: written or exists
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from granary.session import checkpoint, importable

OUTCOME = "object_key string, outcome string, size long, sha256 string"


def local_root(root: str) -> str:
    path = root.removeprefix("file://") if root.startswith("file:///") else root.removeprefix("file:") if root.startswith("file:/") else root
    if "://" in path:
        raise ValueError("objects are put if absent on file systems with hard links only")
    return path.rstrip("/")


def check_key(key: str | None) -> str:
    parts = (key or "").split("/")
    if not key or key.startswith("/") or "\\" in key or "\0" in key or any(p in ("", ".", "..") for p in parts) or parts[0].startswith("."):
        raise ValueError(f"{key!r} is no object key")
    return key


def _sync(folder: str) -> None:
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def _write(path: str, data: bytes, sync: bool = True) -> None:
    with open(path, "xb") as f:
        f.write(data)
        if sync:
            f.flush()
            os.fsync(f.fileno())


#: Files and folders whose file system is asked once to put them on disk, and bytes of such files.
SYNCED, SYNCED_BYTES = 10_000, 256 << 20


def _sync_all(root: str, paths: list[str]) -> None:
    """All of the files and folders on disk: by one call for their file system, where the C library has it, else one by one."""
    if not paths:
        return
    syncfs = getattr(ctypes.CDLL(None, use_errno=True), "syncfs", None)
    if syncfs is None:
        for path in paths:
            _sync(path)
        return
    handle = os.open(root, os.O_RDONLY)
    try:
        if syncfs(handle):
            raise OSError(ctypes.get_errno(), "what was written can't be put on disk", root)
    finally:
        os.close(handle)


@dataclass
class Listed(WriterCommitMessage):
    """Where a task has listed what it staged."""

    path: str
    objects: int


class Stage(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = f"{local_root(options['path'])}/.staging/{options['job']}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        """object_key, content and, where given, the size that the content must have."""
        os.makedirs(self.folder, exist_ok=True)
        listed = f"{self.folder}/{uuid.uuid4().hex}.list"
        n, fresh, held = 0, [], 0
        with open(listed, "x") as names:
            for batch in iterator:
                columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
                sizes = columns.get("size")
                for i, key in enumerate(columns["object_key"].to_pylist()):
                    data = columns["content"][i].as_py() or b""
                    size = sizes[i].as_py() if sizes is not None else None
                    if size is not None and size != len(data):
                        raise ValueError(f"{key!r} has {len(data)} bytes, not {size}")
                    aside = f"{self.folder}/{uuid.uuid4().hex}.tmp"
                    _write(aside, data, sync=False)
                    names.write(json.dumps([check_key(key), aside, len(data), hashlib.sha256(data).hexdigest()]) + "\n")
                    n += 1
                    fresh.append(aside)
                    held += len(data)
                    if len(fresh) == SYNCED or held > SYNCED_BYTES:
                        _sync_all(self.folder, fresh)
                        fresh, held = [], 0
            _sync_all(self.folder, fresh)
            names.flush()
            os.fsync(names.fileno())
        _sync(self.folder)
        return Listed(listed, n)

    def commit(self, messages: list[Listed | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        aside = f"{self.folder}/{uuid.uuid4().hex}.tmp"
        _write(aside, "".join(f"{m.path}\n" for m in messages if m is not None and m.objects).encode())
        os.rename(aside, f"{self.folder}/staged")
        _sync(self.folder)

    def abort(self, messages: list[Listed | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Objects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_objects"

    def schema(self) -> str:
        return "object_key string, content binary, size long"

    def writer(self, schema, overwrite: bool) -> Stage:
        return Stage(self.options)


def stage(df: DataFrame, root: str, job: str) -> None:
    """All objects of df (object_key, content, perhaps size), or none, below the root's staging folder."""
    local_root(root)
    spark = df.sparkSession
    importable(spark)
    spark.dataSource.register(Objects)
    columns = ["object_key", "content"] + (["size"] if "size" in df.columns else [])
    df.select(*columns).write.format("staged_objects").option("path", root).option("job", job).mode("append").save()


def publish(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Link what a job has staged to its keys: (object_key, outcome, size, sha256). It may be repeated: what the job has written stays written."""
    importable(spark)
    base = local_root(root)
    with open(f"{base}/.staging/{job}/staged") as f:
        lists = f.read().split("\n")[:-1]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, folders = [], set()
                with open(path) as f:
                    for line in f:
                        key, aside, size, digest = json.loads(line)
                        target = f"{base}/{key}"
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        try:
                            os.link(aside, target)
                            folders.add(os.path.dirname(target))
                            outcome = "written"
                        except FileExistsError:
                            outcome = "written" if os.path.samefile(aside, target) else "exists"
                        rows.append((key, outcome, size, digest))
                        if len(rows) == SYNCED:
                            _sync_all(base, list(folders))  # what is told is on disk
                            yield _rows(rows)
                            rows, folders = [], set()
                _sync_all(base, list(folders))
                yield _rows(rows)

    names = spark.createDataFrame([(p,) for p in lists], "path string").repartition(max(1, min(len(lists), 20_000)))
    return checkpoint(names.mapInArrow(link, OUTCOME))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["object_key", "outcome", "size", "sha256"])


def put_objects(df: DataFrame, root: str) -> DataFrame:
    """Put df's objects (object_key, content, perhaps size): (object_key, outcome, size, sha256). A key that is there, or was taken by another row or job, `exists`."""
    job = uuid.uuid4().hex
    stage(df, root, job)
    outcome = publish(df.sparkSession, root, job)
    shutil.rmtree(f"{local_root(root)}/.staging/{job}", ignore_errors=True)
    return outcome


def put_manifests(manifests: DataFrame, body, root: str) -> DataFrame:
    """Commit manifests as objects under their day and id; body: the whole manifest as JSON. One that was committed before is refused."""
    from granary.sources.stores import manifest_path

    return put_objects(manifests.select(manifest_path().alias("object_key"), F.encode(body, "utf-8").alias("content")), root)
