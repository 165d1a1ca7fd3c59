"""WARC archives: written with long records in segments, read back by segment reassembly.

Writing: each record is a gzip member of its own; a block longer than `segment` bytes becomes a first record and continuation
records (WARC-Segment-Number, WARC-Segment-Origin-ID, and the total length in the last one). The HTTP body is framed in chunks. A task writes
archives of a bounded size under names of its own and hands on the names of those it finished, so an attempt that is lost leaves
files that nobody reads.

Reading: a task goes through one archive after the other in pieces of a bounded size. Records in one piece are decoded at once; segments are
brought together by their origin's identifier, sorted by number and piece (Spark spills what doesn't fit), and streamed through the same decoder: numbers
must run from 1 without gap or repeat, the total length must be that of the blocks, the chunk framing must end, and a payload digest
in the header must be right. What doesn't hold is named in `problem`. One record is one task's work, as framing and digest are serial;
no record is held whole.

Pages with equal payloads (compared by SHA-256): that with the least page_id is the response, the others revisit it.

Defined results: a null html is empty; rows that repeat a page_id and its html are the same page: all of them are responses (or all
revisit the same one); a null page_id is never the least, unless there is no other: then such rows are responses; a null url has no
WARC-Target-URI; control characters in a url are percent-encoded in the header; without pages there are no archives and no rows. Other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, importable, lookup
from granary.llm.store import _local

#: Bytes of a block in one record, of a chunk of the HTTP body, of an archive (before compression), of what is read at once.
SEGMENT, CHUNK, ARCHIVE, PIECE = 1 << 20, 8 << 10, 64 << 20, 1 << 20
MAX_HEAD = 1 << 16
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, REFERS_TO_PAGE = "X-Page-Id", "X-Refers-To-Page-Id"

ARCHIVES = "archive string, records long, bytes long"
HEADERS = pa.map_(pa.string(), pa.string())
READ = "origin string, segment int, piece int, total long, headers map<string,string>, block binary, payload_bytes long, payload_digest string, problem string"
READ_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), HEADERS, pa.binary(), pa.int64(), pa.string(), pa.string()]
RECORDS = "headers map<string,string>, payload_bytes long, payload_digest string, problem string, piece int, payload binary"
RECORD_TYPES = [HEADERS, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open(uri: str, write: bool = False):
    path = _local(uri)
    if path is not None:
        return open(path, "wb" if write else "rb")
    from pyarrow import fs

    system, target = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(target, compression=None) if write else system.open_input_stream(target, compression=None)


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [f.strip().split(" ")[0] for f in re.sub(r"<[^>]*>", "", schema).split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


# writing


def _header(fields: dict[str, str]) -> bytes:
    clean = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    return VERSION + b"\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in fields.items()) + b"\r\n"


def http_block(payload: bytes | None, chunk: int = CHUNK) -> bytes:
    """An HTTP response with its body in chunks; without payload its header alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        return head + b"\r\n"
    parts = [head, b"Transfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), chunk):
        part = payload[at : at + chunk]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def segments(fields: dict[str, str], block: bytes, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that hold a block: one, or a first and its continuations."""
    if len(block) <= size:
        yield fields, block
        return
    origin, last = fields["WARC-Record-ID"], -(-len(block) // size)
    for k in range(1, last + 1):
        if k == 1:
            head = fields | {"WARC-Segment-Number": "1"}
        else:
            name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin}#{k}')}>"
            head = {"WARC-Type": "continuation", "WARC-Record-ID": name, "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": str(k)}
            if k == last:
                head["WARC-Segment-Total-Length"] = str(len(block))
        yield head, block[(k - 1) * size : k * size]


class _Archive:
    def __init__(self, folder: str):
        self.uri, self.records, self.bytes = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        self.stream = _open(self.uri, write=True)
        self.add({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")

    def add(self, fields: dict[str, str], block: bytes) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        head = _header(fields | {"Content-Length": str(len(block))})
        self.stream.write(b"".join([pack.compress(head), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()]))
        self.records += 1
        self.bytes += len(head) + len(block) + 4

    def close(self) -> tuple[str, int, int]:
        self.stream.close()
        return self.uri, self.records, self.bytes


def write(records: DataFrame, folder: str, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """(archive, records, bytes) of the archives that hold records (headers map, payload binary, sha1 in hex). Without payload only the HTTP header is written, with the digest given."""
    spark = records.sparkSession
    importable(spark)
    path = _local(folder)
    if path is not None:
        import os

        os.makedirs(path, exist_ok=True)
    else:
        from pyarrow import fs

        system, target = fs.FileSystem.from_uri(folder)
        system.create_dir(target, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, now = [pa.string(), pa.int64(), pa.int64()], None
        for batch in batches:
            for fields, payload, sha1 in zip(*batch.columns, strict=True):
                fields, payload, sha1 = dict(fields.as_py()), payload.as_py(), sha1.as_py()
                if payload is not None or sha1:
                    fields["WARC-Payload-Digest"] = "sha1:" + base32(hashlib.sha1(payload).digest() if payload is not None else bytes.fromhex(sha1))
                for head, part in segments(fields, http_block(payload), segment):
                    if now is not None and now.bytes >= archive:
                        yield _batch([now.close()], kinds, ARCHIVES)
                        now = None
                    now = now or _Archive(folder)
                    now.add(head, part)
        if now is not None:
            yield _batch([now.close()], kinds, ARCHIVES)

    return checkpoint(records.select("headers", "payload", "sha1").mapInArrow(work, ARCHIVES))


# reading


class Body:
    """The payload of a block that comes in pieces: HTTP header, then chunks, a given length, or all that follows; or a plain block."""

    def __init__(self, http: bool):
        self.state, self.rest, self.need, self.expected, self.problem = "head" if http else "all", bytearray(), 0, None, None
        self.sha1, self.bytes = hashlib.sha1(), 0

    def _fail(self, why: str) -> None:
        self.problem, self.state = self.problem or why, "bad"

    def _line(self, end: bytes, most: int, why: str) -> bytes | None:
        at = self.rest.find(end)
        if at < 0:
            if len(self.rest) > most:
                self._fail(why)
            return None
        line = bytes(self.rest[:at])
        del self.rest[: at + len(end)]
        return line

    def feed(self, data: bytes) -> bytes:
        self.rest += data
        out = []
        while self.rest:
            state = self.state
            if state == "head":
                head = self._line(b"\r\n\r\n", MAX_HEAD, "http header")
                if head is None:
                    if self.state == "bad":
                        continue
                    break
                fields = dict(re.findall(rb"(?mi)^(transfer-encoding|content-length)[ \t]*:[ \t]*([^\r\n]*)", head.lower()))
                chunked = fields.get(b"transfer-encoding", b"").split(b",")[-1].strip() == b"chunked"
                length = fields.get(b"content-length", b"").strip()
                self.state, self.expected = ("size", None) if chunked else ("all", int(length) if length.isdigit() else None)
            elif state == "size":
                line = self._line(b"\r\n", 1 << 12, "chunk size")
                if line is None:
                    if self.state == "bad":
                        continue
                    break
                size = line.split(b";")[0].strip()
                if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
                    self._fail("chunk size")
                else:
                    self.need = int(size, 16)
                    self.state = "data" if self.need else "trailer"
            elif state == "data":
                part = bytes(self.rest[: self.need])
                del self.rest[: self.need]
                out.append(part)
                self.need -= len(part)
                if not self.need:
                    self.state = "after"
            elif state == "after":
                if len(self.rest) < 2:
                    break
                if self.rest[:2] != b"\r\n":
                    self._fail("chunk end")
                else:
                    del self.rest[:2]
                    self.state = "size"
            elif state == "trailer":
                line = self._line(b"\r\n", MAX_HEAD, "chunk trailer")
                if line is None:
                    if self.state == "bad":
                        continue
                    break
                if not line:
                    self.state = "done"
            elif state == "all":
                out.append(bytes(self.rest))
                self.rest.clear()
            else:
                if state == "done":
                    self._fail("bytes after the last chunk")
                self.rest.clear()
        found = b"".join(out)
        self.sha1.update(found)
        self.bytes += len(found)
        return found

    def end(self) -> str | None:
        if self.problem is None and self.state not in ("all", "done"):
            self.problem = "http header" if self.state == "head" else "chunks cut off"
        if self.problem is None and self.expected is not None and self.expected != self.bytes:
            self.problem = "content length"
        return self.problem


def _is_http(fields: dict[str, str]) -> bool:
    return fields.get("Content-Type", "").lower().startswith("application/http")


def _result(fields: dict[str, str], body: Body, problem: str | None) -> tuple:
    """payload_bytes, payload_digest and problem; a revisit has no payload of its own."""
    problem = problem or (None if fields.get("WARC-Type") == "revisit" and body.state == "all" else body.end())
    said = fields.get("WARC-Payload-Digest", "")
    if fields.get("WARC-Type") == "revisit":
        return None, said.removeprefix("sha1:") or None, problem
    found = base32(body.sha1.digest())
    if problem is None and said.startswith("sha1:") and said.removeprefix("sha1:") != found:
        problem = "payload digest"
    return body.bytes, found, problem


def _blocks(stream) -> Iterator[tuple[dict[str, str], bytes, bool, str | None]]:
    """(header, piece of the block, is it the last, problem) of the records in an uncompressed stream. What can't be read ends it with a problem."""
    while True:
        line = stream.readline(MAX_HEAD)
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            yield {}, b"", True, "no record here"
            return
        fields, size = {}, len(line)
        for line in iter(lambda: stream.readline(MAX_HEAD), b""):
            size += len(line)
            if line in (b"\r\n", b"\n") or size > MAX_HEAD:
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        if line not in (b"\r\n", b"\n") or not fields.get("Content-Length", "").isdigit():
            yield fields, b"", True, "record header"
            return
        left = int(fields["Content-Length"])
        while True:
            part = stream.read(min(left, PIECE))
            left -= len(part)
            cut = left and not part
            yield fields, part, bool(cut) or not left, "record cut off" if cut else None
            if cut:
                return
            if not left:
                break


def _archive_blocks(uri: str) -> Iterator[tuple[dict[str, str], bytes, bool, str | None]]:
    import io

    with _open(uri) as raw:
        stream = io.BufferedReader(raw, PIECE) if isinstance(raw, io.RawIOBase) else raw
        first = stream.read(2)
        stream.seek(0)
        if first != b"\x1f\x8b":
            yield from _blocks(stream if hasattr(stream, "readline") else io.BufferedReader(stream))
            return
        try:
            yield from _blocks(gzip.GzipFile(fileobj=stream))
        except (EOFError, zlib.error, gzip.BadGzipFile):
            yield {}, b"", True, "archive cut off"


def records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """(headers, payload_bytes, payload_digest, problem, piece, payload) of all records but continuations. With `payloads` the payload comes as rows in order of
    piece, the last of which has the totals (in the others they are null); without, a record is one row."""
    importable(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                body, piece, lost = None, 0, None
                for fields, part, last, problem in _archive_blocks(uri):
                    number, origin = fields.get("WARC-Segment-Number"), fields.get("WARC-Record-ID")
                    if number is not None and number.isdigit():
                        total = fields.get("WARC-Segment-Total-Length", "")
                        head = None if fields.get("WARC-Type") == "continuation" else list(fields.items())
                        rows.append((fields.get("WARC-Segment-Origin-ID", origin), int(number), piece, int(total) if total.isdigit() else None, head if piece == 0 else None, part, None, None, problem))
                        held += len(part)
                    else:
                        body = body or Body(_is_http(fields))
                        found = body.feed(part)
                        keep, held = (found if payloads else None), held + (len(found) if payloads else 0)
                        if last:
                            rows.append((origin, None, piece, None, list(fields.items()), keep, *_result(fields, body, problem)))
                            body = None
                        elif payloads and found:
                            rows.append((origin, None, piece, None, list(fields.items()), keep, None, None, None))
                    piece = 0 if last else piece + 1
                    if held > PIECE or len(rows) >= 1000:
                        yield _batch(rows, READ_TYPES, READ)
                        rows, held = [], 0
        yield _batch(rows, READ_TYPES, READ)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], 0, None

        def ended() -> None:
            fields, body, problem = now["fields"], now["body"], now["problem"]
            if problem is None and now["total"] is None:
                problem = "no last segment"
            if problem is None and now["total"] != now["length"]:
                problem = "total length"
            rows.append((list(fields.items()), *_result(fields, body, problem), now["pieces"], b"" if payloads else None))

        for batch in batches:
            for origin, segment, piece, total, headers, block, size, sha1, problem in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if segment is None:
                    rows.append((headers, size, sha1, problem, piece, block))
                    held += len(block or b"")
                else:
                    if now is None or now["origin"] != origin:
                        if now is not None:
                            ended()
                        fields = dict(headers or {"WARC-Record-ID": origin, "WARC-Type": "continuation"})
                        now = {"origin": origin, "fields": fields, "body": Body(_is_http(fields)), "segment": 0, "piece": -1, "length": 0, "total": None, "pieces": 0, "problem": None}
                    follows = (segment == now["segment"] + 1 and piece == 0) or (segment == now["segment"] and piece == now["piece"] + 1)
                    if not follows or now["total"] is not None and segment != now["segment"]:
                        now["problem"] = now["problem"] or ("no first segment" if not now["segment"] else "segment missing" if segment > now["segment"] else "segment twice")
                    now["segment"], now["piece"], now["problem"] = segment, piece, now["problem"] or problem
                    now["length"] += len(block)
                    now["total"] = total if total is not None else now["total"]
                    found = now["body"].feed(block) if now["problem"] is None else b""
                    if payloads and found:
                        rows.append((list(now["fields"].items()), None, None, None, now["pieces"], found))
                        now["pieces"] += 1
                        held += len(found)
                if held > PIECE or len(rows) >= 1000:
                    yield _batch(rows, RECORD_TYPES, RECORDS)
                    rows, held = [], 0
        if now is not None:
            ended()
        yield _batch(rows, RECORD_TYPES, RECORDS)

    # One archive a partition; a record that is decoded already only passes through, under a number of its own.
    n = max(1, min(archives.count(), 20_000))
    parts = archives.select("archive").repartition(n).mapInArrow(read, READ)
    spread = F.when(F.col("segment").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("origin"))
    dealt = parts.withColumn("__to", spread).repartition("__to").sortWithinPartitions("origin", "segment", "piece").drop("__to")
    return dealt.mapInArrow(join, RECORDS)


# pages


def page_records(pages: DataFrame) -> DataFrame:
    """(headers, payload, sha1) of pages (page_id, url, html): the first of equal payloads as response, the others as revisits without payload.

    The payloads' digests are grouped first; of the groups of copies the largest are broadcast (`lookup`), so a page that many copy is not one task's work."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    groups = checkpoint(rows.groupBy("digest", F.sha1("payload").alias("sha1")).agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    known = lookup(rows, groups.select("digest", "least", "sha1"), ["digest"], groups.select("digest", "n"))
    again = F.col("least").isNotNull() & ~F.col("least").eqNullSafe(F.col("page_id"))
    number = F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.monotonically_increasing_id())
    hexed = F.sha1(number)
    name = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    fields = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", name), ("WARC-Date", F.lit("1970-01-01T00:00:00Z")), ("Content-Type", F.lit("application/http; msgtype=response")),
        ("WARC-Target-URI", F.col("url")), (PAGE, F.col("page_id").cast("string")), ("WARC-Profile", F.when(again, IDENTICAL)), (REFERS_TO_PAGE, F.when(again, F.col("least").cast("string"))),
    ]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields]), lambda e: e["value"].isNotNull())
    return known.select(F.map_from_entries(entries).alias("headers"), F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("sha1")).alias("sha1"))


def read_pages(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem) of the pages in archives; a revisit has the size of the payload that it refers to."""
    h = lambda name: F.col("headers").getItem(name)
    found = records(archives).select(
        h(PAGE).cast("long").alias("page_id"), "payload_bytes", "payload_digest", h("WARC-Type").alias("record_type"), h(REFERS_TO_PAGE).cast("long").alias("refers_to"), "problem"
    )
    found = checkpoint(found.where("record_type in ('response', 'revisit')"))
    first = found.where("record_type = 'response'")
    values = first.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = found.where("record_type = 'revisit'").drop("payload_bytes")
    resolved = lookup(again, values, ["refers_to", "payload_digest"], again.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n")))
    lost = F.when(F.col("payload_bytes").isNull(), "no response")
    return first.unionByName(resolved.withColumn("problem", F.coalesce("problem", lost)).select(first.columns))
