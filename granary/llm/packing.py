"""Best-fit packing by bin completion.

`tokenise` turns each document into token ids plus an end id and cuts longer ones into pieces of `capacity`
(the first piece takes the remainder). `pack` fills sequences: pieces are dealt by a hash of their key to
groups, about one for every GROUP_CHARS characters, so that a task's memory doesn't grow with the corpus and a lost
task gives the same result again. In a group pieces of full length are sequences by themselves. For the others best fit
decreasing gives the incumbent; if it has more sequences than a lower bound on all packings, bin completion
looks for a better one: depth first, always around the largest piece left, over all fillings that no other filling
dominates (a filling is dominated if a piece in stock could take the place of none, one or several of its pieces and still
fit), best filled first, cutting branches whose waste would exceed what one sequence fewer than the incumbent allows. All
pieces are searched once, as far as one descent and some way back; then the worst filled sequences of the incumbent, then twice as many, and so on.

Packing is NP-hard: the search of a group ends after NODES branches at the latest, and the incumbent stands. That bounds time only; no piece
is left out, and fillings are listed in full while the search goes on. Groups cost at most one partly filled sequence each. With integer
lengths many pieces are equally long, so the search works on counts of lengths.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty one; other columns are left out. Null ids are packed as any other.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import MAX_PARTS, dealt, importable

CAPACITY = 1024
END = 2
#: Pieces of about so many characters of text are packed together.
GROUP_CHARS = 12_000_000
#: Branches tried for a group before the incumbent stands, and for one set of its sequences.
NODES, TRY = 1_200, 300
PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


# Fixed value: how byte-level vocabularies of this kind cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


LONG_SPACE = re.compile(r"(?<!\s)\s{50000}")


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary file, as little-endian unsigned 32-bit integers.

    The ids are those of `tokenizers` with that file. In such a vocabulary a token's id is its merge's rank, so the merging
    itself is left to `tiktoken`, which does it several times as fast. A text that holds an added token's string, or a run of white space longer than `tiktoken`'s stack allows, goes to `tokenizers`."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self.whole = path, None
        self.added = [x["content"] for x in file["added_tokens"]]
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {x: x for x in shown} | {256 + k: x for k, x in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(byte_of[ord(c)] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.added}
        self.merge = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.added) or LONG_SPACE.search(text):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        return packed(self.merge(text))


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = packed([end])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows: list[list] = [[], [], [], [], [], []]
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    for piece, start in enumerate([0, *range(first, n, capacity)]):
                        to = first if not piece else start + capacity
                        x = ids[4 * start : 4 * to]
                        for column, value in zip(rows, (doc_id, piece, start, to - start, x, zlib.crc32(x)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing; bins by room left."""
    at: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted, distinct
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        if k < len(rooms):
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del at[room]
                rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        left = room - x
        if left:
            if left not in at:
                at[left] = []
                insort(rooms, left)
            at[left].append(b)
    return bins


def least(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for each a, pieces over capacity - a have room for none of a or more, those
    over half of the capacity stand alone, and the rest down to a fills what room the latter leave."""
    n = np.zeros(capacity + 1, np.int64)
    for x, k in counts.items():
        n[x] = k
    size = np.arange(capacity + 1)
    half = capacity // 2
    best = -(-int((n * size).sum()) // capacity)
    for a in range(half + 1):
        big = int(n[capacity - a + 1 :].sum())
        middle = slice(half + 1, capacity - a + 1)
        room = int(n[middle].sum()) * capacity - int((n * size)[middle].sum())
        rest = int((n * size)[a : half + 1].sum())
        best = max(best, big + int(n[middle].sum()) + max(0, -(-(rest - room) // capacity)))
    return best


def fillings(counts: dict[int, int], sizes: list[int], room: int, waste: int) -> Iterator[list[int]]:
    """All undominated ways to fill room from the lengths in stock (`sizes` ascending) that leave `waste` of it at most, the fullest first."""
    small = sizes[: bisect_right(sizes, room)]
    full = (2 << room) - 1
    sums = [1]  # sums[k]: bits of the sums that lengths small[:k] give
    for x in small:
        m = sums[-1]
        if m != full:
            n, step = min(counts[x], room // x), 1
            while n:
                step = min(step, n)
                m |= m << x * step
                n, step = n - step, 2 * step
            m &= full
        sums.append(m)
    stock = 0
    for x in small:
        stock |= 1 << x

    def ways(k: int, want: int) -> Iterator[list[int]]:
        """From small[:k], with exactly that sum."""
        if not want:
            yield []
        while k and sums[k] >> want & 1 and want:
            k -= 1
            x = small[k]
            for n in range(min(counts[x], want // x), 0, -1):
                if sums[k] >> want - n * x & 1:
                    for w in ways(k, want - n * x):
                        yield n * [x] + w

    for left in range(min(waste, room) + 1):
        for way in ways(len(small), room - left):
            if undominated(way, left, counts, stock):
                yield way


def undominated(way: list[int], left: int, counts: dict[int, int], stock: int) -> bool:
    """Whether no piece in stock (bits of lengths) could take the place of none, one (if it is longer) or several pieces of the filling, and still fit."""
    one = many = 0  # bits of lengths, and of sums of several
    for x in way:
        many |= (many | one) << x
        one |= 1 << x
        if counts[x] == way.count(x):
            stock &= ~(1 << x)
    if stock & ((2 << left) - 1):
        return False
    better, reach = many, one | many
    for _ in range(left):
        reach <<= 1
        better |= reach
    return not better & stock


def search(lengths: list[int], capacity: int, target: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """A packing into at most `target` sequences if the search finds one within so many branches; the branches it took."""
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    sizes = sorted(counts)
    spare = target * capacity - sum(lengths)  # what may be wasted in all
    bins: list[list[int]] = []
    stack: list[Iterator[list[int]]] = []
    used = 0

    def take(b: list[int], sign: int) -> None:
        nonlocal spare
        spare -= sign * (capacity - sum(b))
        for x in b:
            n = counts.get(x, 0) - sign
            if n and x not in counts:
                insort(sizes, x)
            counts[x] = n
            if not n:
                sizes.pop(bisect_left(sizes, x))
                del counts[x]

    def around_largest() -> Iterator[list[int]]:
        top = sizes[-1]
        stock = dict(counts)
        stock[top] -= 1
        if not stock[top]:
            del stock[top]
        return ([top, *w] for w in fillings(stock, sorted(stock), capacity - top, spare))

    if spare < 0:
        return None, 0
    stack.append(around_largest())
    while stack and used < nodes:
        b = next(stack[-1], None)
        if b is None:
            stack.pop()
            if bins:
                take(bins.pop(), -1)
            continue
        used += 1
        take(b, 1)
        bins.append(b)
        if not sizes:
            return bins, used
        stack.append(around_largest())
    return None, used


def complete(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Lengths of each sequence: best fit decreasing as first incumbent, then bin completion over its worst filled sequences."""
    best = best_fit(lengths, capacity)
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    bound = least(counts, capacity)
    if len(best) > bound:  # one descent, over the best filling around each largest piece, and what can be changed at its end
        found, used = search(lengths, capacity, len(best) - 1, len(best) + TRY)
        best, nodes = found or best, nodes - max(0, used - len(best))
    n = 8
    while len(best) > bound and nodes > 0:
        best.sort(key=sum)
        n = min(n, len(best))
        found, used = search([x for b in best[:n] for x in b], capacity, n - 1, min(nodes, TRY if n < len(best) else nodes))
        nodes -= used
        if found:
            best, n = found + best[n:], 8
        elif n == len(best):
            break
        else:
            n *= 2
    return best


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY, most: int = MAX_PARTS) -> DataFrame:
    """The pieces with sequence_id and offset; the pieces are dealt to that many groups, one for each task, or several one after the other beyond `most` tasks."""
    width = 2**40

    def packed_group(t: pa.Table, group: int) -> pa.Table:
        lengths = t.column("length").to_numpy()
        order = np.lexsort((t.column("ids_crc32").to_numpy(), t.column("piece").to_numpy(), t.column("doc_id").fill_null(-1).to_numpy(), lengths))
        stock: dict[int, list[int]] = {}
        for i in order.tolist():
            stock.setdefault(int(lengths[i]), []).append(i)
        full = stock.get(capacity, [])
        bins = complete([x for x in lengths.tolist() if x < capacity], capacity)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        first = group * width
        seq[full] = first + np.arange(len(full))
        for k, b in enumerate(bins, len(full)):
            at = 0
            for x in b:
                i = stock[x].pop()
                seq[i], off[i] = first + k, at
                at += x
        return t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if got:
            yield from packed_group(pa.Table.from_batches(got), TaskContext.get().partitionId()).to_batches()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = -1, []
        for batch in batches:
            numbers = batch.column(batch.num_columns - 1).to_numpy()
            rest = batch.select(range(batch.num_columns - 1))
            ends = [*(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip([0, *ends], ends, strict=False):
                if held and int(numbers[a]) != group:
                    yield from packed_group(pa.Table.from_batches(held), group).to_batches()
                    held = []
                group = int(numbers[a])
                held.append(rest.slice(a, b - a))
        if held:
            yield from packed_group(pa.Table.from_batches(held), group).to_batches()

    if groups <= most:
        return pieces.repartition(groups, "doc_id", "piece").mapInArrow(one, PLACED)
    numbered = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt(numbered, "__group", groups, most).mapInArrow(several, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents to placed pieces; groups by the characters of all texts."""
    importable(docs.sparkSession)
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return pack(tokenise(docs, tokenizer, capacity), max(1, -(-chars // GROUP_CHARS)), capacity)
