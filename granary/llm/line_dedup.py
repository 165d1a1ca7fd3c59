"""Line dedup by pairwise alignment.

Lines are told by a hash of the line without outer white space. Overlapping documents are looked for by what they share and few lines are: windows of one to BLOCK
lines that follow each other (lines without text not counted) and have BLOCK lines, or LONG words (or 16 * LONG bytes), or all the text of a document. Shorter
windows, such as a single short line, are no overlap, however few or many documents hold them. The first
document (least id) that holds a window is its anchor, and every other one that holds it is paired with the anchor: one pair for each window and
document at most, never all pairs. So of two documents that share a block, the later one meets a document that holds each window of
the block, be it the other or one before both.

A pair is aligned with patience diff: lines that occur once in both documents and in the same order are
fixed points, the stretches between them are aligned in turn, and equal lines next to fixed points join them; where that finds no common block any more, the first places of shared windows
are the fixed points. Runs of aligned lines that are as long as a window must be are common blocks: these are deleted from the later document, and with them their windows wherever else
it repeats them. What is left of it is aligned again until there is no common block, as blocks can come in another order than in the anchor.

The alignment of a document with its anchors deletes what the alignment with all earlier documents would (tested): lines are deleted exactly if they
lie in a window that a document with a lesser id holds too. Lines of white space alone go between two lines of one common block, and with a copy of the whole text.

Only hashes of lines are shuffled for the search; texts move once, to meet the lists of deleted lines. A window that many hold meets its anchor by broadcast (`lookup`), so its holders
stay where they are. The lines of an anchor go once to each group of SPLIT pairs, not to each pair.

Defined results: null and empty texts have no line and stay as they are; lines of white space alone are no
evidence; of rows that repeat an id the one with the least list of line hashes is
compared, and what is deleted from it is deleted from the others where they have the same lines in the same places; a
null id is neither anchor nor changed; an empty table gives an empty one; other columns stay (but for an old `deleted_lines`).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import checkpoint, importable, lookup
from granary.llm.text import mix

#: Lines of a window at most, and of a block that needs no words to be one.
BLOCK = 3
#: Words of a long window; scripts without spaces count by bytes. At most 15.
LONG = 10
#: Pairs of one anchor that are aligned together.
SPLIT = 500
WHITE = b" \t\n\x0b\x0c\r"


def digest(line: bytes) -> int:
    """0 without text; else 59 bits of a hash, then 4 bits: the line's words (or bytes / 16), LONG at most."""
    line = line.strip(WHITE)
    if not line:
        return 0
    weight = LONG if len(line) >= 16 * LONG else max(min(LONG, len(line.split())), len(line) // 16)
    return (xxhash.xxh3_64_intdigest(line) >> 5 or 1) << 4 | weight


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, lines: a hash for each line, 0 for one without text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            out = []
            for t in texts:
                out.append([digest(x) for x in t.as_buffer().to_pybytes().split(b"\n")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").mapInArrow(work, "doc_id long, lines array<long>")


Window = tuple[int, ...]


def is_strong(run: list[int] | Window, block: int = BLOCK) -> bool:
    """Whether lines that follow each other are enough for a common block."""
    return len(run) >= block or sum(x & 15 for x in run) >= LONG


def strong_windows(text: list[int], block: int = BLOCK) -> Iterator[tuple[int, Window]]:
    """(place, window) of windows of up to `block` lines that are enough; negative numbers stand for lines out of question."""
    for i in range(len(text)):
        for size in range(1, min(block, len(text) - i) + 1):
            w = tuple(text[i : i + size])
            if w[-1] < 0:
                break
            if is_strong(w, block):
                yield i, w


class Anchor:
    """A document that others are aligned with: its lines, those with text, and the first places of its windows among these."""

    def __init__(self, lines: list[int], block: int = BLOCK):
        self.lines, self.block, self.text = lines, block, [x for x in lines if x]
        self.held: dict[Window, int] = {}
        for i, w in strong_windows(self.text, block):
            self.held.setdefault(w, i)


def rising(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of points that rises in both; the points come in order of j."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for e, (i, _) in enumerate(points):
        k = bisect_left(tops, i)
        before.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(i)
            ends.append(e)
        else:
            tops[k], ends[k] = i, e
    chain, e = [], ends[-1] if ends else -1
    while e >= 0:
        chain.append(points[e])
        e = before[e]
    return chain[::-1]


def patience(a: list[int], b: list[int], wanted: set[Window] | None = None) -> list[tuple[int, int]]:
    """Aligned places (i, j), rising in both. With `wanted` the fixed points between all of a and b are first places of these windows, else lines that occur once in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if wanted:
            sizes = range(max(map(len, wanted)), 0, -1)
            first = {tuple(a[i : i + n]): i for n in sizes for i in range(len(a) - n, -1, -1)}
            meets = [(j, next((first[w] for n in sizes if (w := tuple(b[j : j + n])) in wanted and w in first), -1)) for j in range(len(b))]
            points, wanted = [(i, j) for j, i in meets if i >= 0], None
        else:
            while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
                found.append((i0, j0))
                i0, j0 = i0 + 1, j0 + 1
            while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
                i1, j1 = i1 - 1, j1 - 1
                found.append((i1, j1))
            if i0 == i1 or j0 == j1:
                continue
            in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
            at = {x: i for i, x in enumerate(a[i0:i1], i0) if in_a[x] == 1 and in_b[x] == 1}
            points = [(at[x], j) for j, x in enumerate(b[j0:j1], j0) if x in at]
        if chain := rising(points):
            found += chain
            for (i, j), (k, m) in zip([(i0 - 1, j0 - 1), *chain], [*chain, (i1, j1)], strict=True):
                todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def runs_of(aligned: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """[from, to) in b of the runs of aligned lines."""
    at = 0
    while at < len(aligned):
        to = at + 1
        while to < len(aligned) and aligned[to] == (aligned[to - 1][0] + 1, aligned[to - 1][1] + 1):
            to += 1
        yield aligned[at][1], aligned[to - 1][1] + 1
        at = to


def blocks(a: Anchor, b: list[int]) -> list[int]:
    """Places in the lines b of the common blocks to delete."""
    place = [k for k, x in enumerate(b) if x]
    rest = [b[k] for k in place]
    if rest and rest == a.text:
        return list(range(len(b))) if a.lines == b else list(range(place[0], place[-1] + 1))
    out: set[int] = set()
    shared = [(i, w) for i, w in strong_windows(rest, a.block) if w in a.held]
    by_windows = False
    while shared:
        # what is in no shared window that is left can't be in another common block; each such line gets a number of its own
        inside = {k for i, w in shared for k in range(i, i + len(w))}
        open_ = [x if k in inside else ~k for k, x in enumerate(rest)]
        aligned = patience(a.text, open_, {w for _, w in shared} if by_windows else None)
        common = [(lo, hi) for lo, hi in runs_of(aligned) if is_strong(rest[lo:hi], a.block)]
        taken = {w for lo, hi in common for _, w in strong_windows(rest[lo:hi], a.block)}
        common += [(i, i + len(w)) for i, w in shared if w in taken]
        for lo, hi in common:
            out.update(range(place[lo], place[hi - 1] + 1))
        left = [(i, w) for i, w in shared if w not in taken]
        if len(left) == len(shared) and by_windows:
            break
        by_windows = len(left) == len(shared)
        shared = left
    return sorted(out)


def held_windows(seen: DataFrame, block: int) -> DataFrame:
    """doc_id, window (hash): each window of a document that is enough for an overlap, once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, 500):
                part = batch.column(1).slice(at, 500)
                lists = pa.array(part, pa.list_(pa.int64()))
                lines = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                row = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                row, lines = row[lines != 0], lines[lines != 0]
                n = len(lines)
                first = np.searchsorted(row, np.arange(len(part)))
                place = np.arange(n) - first[row]
                found: list[list[np.ndarray]] = [[], []]
                key = np.zeros(n, np.uint64)
                weight = np.zeros(n, np.int64)
                size_of = np.bincount(row, minlength=len(part))
                for size in range(1, block + 1):
                    k = np.flatnonzero(place + size <= size_of[row])  # windows that end within their text
                    key[k] = mix(key[k] * np.uint64(0xD6E8FEB86659FD93) + lines[k + size - 1])
                    weight[k] += (lines[k + size - 1] & np.uint64(15)).astype(np.int64)
                    whole = (size < block) & (place[k] == 0) & (size_of[row[k]] == size)
                    enough = k[(weight[k] >= LONG) | (size == block)]
                    # all the text of a document is an overlap with an equal one only
                    w = k[whole]
                    for column, x in zip(found, ([row[enough], row[w]], [key[enough], mix(key[w] + np.uint64(size))]), strict=True):
                        column += x
                rows, keys = (np.concatenate(x) for x in found)
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
                new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])]) if len(rows) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + rows[new]]), pa.array(keys[new].view(np.int64))], names=["doc_id", "window"])

    return seen.mapInArrow(work, "doc_id long, window long")


def repeated_lines(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """later, gone: the (place, line hash) of lines to delete from document `later`."""
    seen = checkpoint(line_hashes(docs).groupBy("doc_id").agg(F.min("lines").alias("lines")))
    held = held_windows(seen, block)
    firsts = checkpoint(held.groupBy("window").agg(F.min("doc_id").alias("anchor"), F.count("*").alias("n")).where("n > 1"))
    met = lookup(held, firsts.select("window", "anchor"), ["window"], firsts.select("window", "n")).where("doc_id <> anchor")
    pairs = checkpoint(met.select("anchor", F.col("doc_id").alias("later")).distinct())
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    groups = pairs.groupBy("anchor").agg(F.count("*").alias("n")).select("anchor", parts.alias("parts"))
    groups = checkpoint(groups)
    at = F.struct("anchor", F.pmod(F.xxhash64("later"), F.col("parts")).cast("int").alias("part"))
    # The lines of both sides, the anchor's once for each of its parts; a part is worked on from its anchor's row on.
    later = pairs.join(groups, "anchor").select(at.alias("at"), "later").join(seen.toDF("later", "lines"), "later").select("at", "later", "lines")
    firsts = seen.toDF("anchor", "lines").join(groups, "anchor").select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "lines")
    firsts = firsts.select(F.struct("anchor", "part").alias("at"), F.lit(None).cast("long").alias("later"), "lines")
    both = firsts.union(later).repartition("at").sortWithinPartitions("at", F.col("later").asc_nulls_first()).select("later", "lines")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Anchor([], block)
        for batch in batches:
            later, found = [], []
            for row in range(batch.num_rows):
                d, b = (c[row].as_py() for c in batch.columns)
                if d is None:
                    a = Anchor(b, block)
                elif gone := blocks(a, b):
                    later.append(d)
                    found.append([{"place": k, "line": b[k]} for k in gone])
            yield pa.RecordBatch.from_arrays([pa.array(later, pa.int64()), pa.array(found, pa.list_(pa.struct([("place", pa.int32()), ("line", pa.int64())])))], names=["later", "gone"])

    gone = both.mapInArrow(work, "later long, gone array<struct<place:int,line:long>>")
    return gone.groupBy("later").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs with the text that is left, and `deleted_lines`: places (from 0) of the deleted lines, null for none."""
    importable(docs.sparkSession)
    docs = docs.drop("deleted_lines")
    gone = checkpoint(repeated_lines(docs.select("doc_id", "text"), block).toDF("__later", "deleted_lines"))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("__later"), "left").drop("__later")
    place, at = joined.columns.index("text"), joined.columns.index("deleted_lines")
    schema = T.StructType([*docs.schema.fields, T.StructField("deleted_lines", T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            column, gone = columns[place], columns[at]
            deleted: list = [None] * len(gone)
            if gone.null_count < len(gone):
                texts = column.to_pylist()
                for i, found in enumerate(gone.to_pylist()):
                    if found and texts[i] is not None:
                        lines = texts[i].split("\n")
                        # another row with the same id may have other lines
                        drop = {x["place"] for x in found if x["place"] < len(lines) and digest(lines[x["place"]].encode()) == x["line"]}
                        texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
                        deleted[i] = sorted(drop) or None
                columns[place] = pa.array(texts, column.type)
            columns[at] = pa.array(deleted, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return joined.mapInArrow(work, schema)
