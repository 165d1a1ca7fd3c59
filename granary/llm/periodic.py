"""Periodic runs: stretches of words that repeat with a period, found by the runs theorem.

A run is a maximal stretch with smallest period q (words q apart are equal) and at least twice q long; here those are kept that are at
least `exponent` times q and `shortest` words long. By the runs theorem the root of every run occurs as the longest Lyndon word that starts at some
position, under the order of the words or under the reverse order. So for a text of n words:

1. its suffixes are sorted by doubling (words, then 2, 4, 8, ... of them), which also gives the inverse suffix array and, from the ranks of
   each doubling, the longest common prefixes of neighbours;
2. the longest Lyndon word at i ends before the next smaller value of the inverse suffix array, under the reverse order before the next
   larger one (the end of the text is smaller than every word);
3. each such word is extended to the right by the common prefix of the suffixes at its start and its end, a minimum over a range of common
   prefixes from a sparse table, and to the left by the same on the text read backwards.

Texts are worked on in groups of some 200,000 words, each word numbered within its text, so suffixes of different texts never compare. A run
of the sizes asked for holds some stretch of shortest * (exponent - 1) / exponent words twice; texts without such a repeat leave after the
first doublings. A task holds one group, about 250 bytes for each word of a longer text. Nothing is shuffled.

Defined results: a null or blank text has no runs and an empty collapsed text; rows that repeat are each worked on; without rows there are none. The
columns of the input stay together as `row`, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import importable

#: Words that are worked on together (a longer text is a group of its own).
GROUP = 200_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Suffixes:
    """Sorted suffixes of several texts of numbers; offsets: where each text starts, and the end."""

    def __init__(self, numbers: np.ndarray, offsets: np.ndarray, most: int | None = None):
        n = len(numbers)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        ends = offsets[1:][self.text]
        key = self.text * (int(numbers.max(initial=0)) + 1) + numbers
        order = np.argsort(key, kind="stable")
        first = np.ones(n, bool)  # an entry that differs from the one before
        first[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.ranks = [rank.astype(np.int32)]
        self.parted = np.where(first, 0, 127).astype(np.int8)  # the doubling that told an entry from the one before
        width = 1
        while True:
            open_ = ~first
            open_[:-1] |= ~first[1:]
            at = np.flatnonzero(open_)
            if not len(at) or (most is not None and width >= most):
                break
            i = order[at]
            behind = i + width
            second = np.where(behind < ends[i], rank[np.minimum(behind, n - 1)], -1)
            key = rank[i] * (n + 1) + second + 1
            to = np.argsort(key, kind="stable")
            i, key = i[to], key[to]
            order[at] = i
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            fresh = at[new & ~first[at]]
            self.parted[fresh], first[fresh] = len(self.ranks), True
            rank[i] = np.maximum.accumulate(np.where(new, at, 0))
            width *= 2
            if most is None:
                self.ranks.append(rank.astype(np.int32))
        #: Numbers of the texts in which some `most` words occur twice.
        self.repeating = np.unique(self.text[order[at]])
        self.order, self.place = order, rank

    def prepare(self) -> Suffixes:
        """Common prefixes of neighbours and their sparse table; the ranks of the doublings go."""
        common = np.zeros(len(self.order), np.int32)
        for k in range(len(self.ranks) - 1, -1, -1):
            t = np.flatnonzero(self.parted > k)
            rank = np.append(self.ranks[k], np.int32(-1))
            same = rank[self.order[t - 1] + common[t]] == rank[self.order[t] + common[t]]
            common[t] += same.astype(np.int32) << k
        self.ranks = []
        longest = int(np.bincount(self.text).max(initial=1))
        table = [common]
        while 2 << (len(table) - 1) <= longest:
            half, last = 1 << (len(table) - 1), table[-1]
            wider = last.copy()
            wider[:-half] = np.minimum(last[:-half], last[half:])
            table.append(wider)
        self.table = np.stack(table)
        return self

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j, different places of one text."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, a], self.table[k, b - (1 << k.astype(np.int64)) + 1]).astype(np.int64)


def next_smaller(values: list[int]) -> list[int]:
    """Place of the next smaller value, or the length."""
    out, waiting = [len(values)] * len(values), []
    for i, x in enumerate(values):
        while waiting and values[waiting[-1]] > x:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def repetitions(numbers: np.ndarray, offsets: np.ndarray, shortest: int = 24, exponent: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs with length >= max(shortest, exponent * period), by text, start and period; starts count from the text's own."""
    none = np.zeros(0, np.int64)
    repeat = max(1, -(-shortest * (exponent - 1) // exponent))
    for round_ in (0, 1):
        if not len(numbers):
            return none, none, none, none
        if round_ == 0:  # the texts that can have a run
            most = 1 << (repeat.bit_length() - 1)
            texts = Suffixes(numbers, offsets, most).repeating
            if len(texts) == 0:
                return none, none, none, none
            sizes = np.diff(offsets)[texts]
            taken = np.concatenate([np.arange(offsets[t], offsets[t + 1]) for t in texts])
            numbers, offsets = numbers[taken], np.concatenate([[0], np.cumsum(sizes)])
    forward = Suffixes(numbers, offsets).prepare()
    start, end = offsets[:-1][forward.text], offsets[1:][forward.text]
    mirror = start + end - 1 - np.arange(len(numbers))
    backward = Suffixes(numbers[mirror], offsets).prepare()
    found = []
    place = forward.place
    for values in (place, -place):
        period = np.minimum(np.array(next_smaller(values.tolist()), np.int64), end) - np.arange(len(numbers))
        i = np.flatnonzero(np.arange(len(numbers)) + period < end)
        i = i[numbers[i] == numbers[i + period[i]]]
        p = period[i]
        right = forward.common(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > start[i])
        left[inner] = backward.common(mirror[i[inner] - 1], mirror[i[inner] + p[inner] - 1])
        length = left + p + right
        keep = length >= np.maximum(shortest, exponent * p)
        found.append(np.stack([i[keep] - left[keep], length[keep], p[keep]]))
    s, length, p = np.concatenate(found, axis=1)
    one = np.unique(s * (len(numbers) + 1) + p, return_index=True)[1]  # sorted by text, start and period
    s, length, p = s[one], length[one], p[one]
    return texts[forward.text[s]], s - start[s], length, p


def _group(words: list[list[bytes]]) -> Iterator[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each text of a group."""
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    flat = pa.array([x for w in words for x in w], pa.large_binary())
    numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, start, length, period = repetitions(numbers, offsets)
    bounds = np.searchsorted(text, np.arange(len(words) + 1))
    for d, w in enumerate(words):
        a, b = bounds[d], bounds[d + 1]
        if a == b:
            yield [], b" ".join(w)
            continue
        change = np.zeros(len(w) + 1, np.int64)
        np.add.at(change, start[a:b] + period[a:b], 1)
        np.add.at(change, start[a:b] + length[a:b], -1)
        keep = np.cumsum(change)[:-1] == 0
        yield [{"start": s, "length": n, "period": p} for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)], b" ".join(compress(w, keep.tolist()))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, runs, collapsed): the input's columns; its runs of words, by start and period; its words joined by a space, without those that a run repeats (all
    in some run but in its first period)."""
    importable(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("runs", T.ArrayType(T._parse_datatype_string(RUN))), T.StructField("collapsed", T.StringType())])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = pc.struct_field(row, text)
            at = 0
            while at < len(row):
                words, n = [], 0
                while at + len(words) < len(row) and (not words or n < GROUP):
                    x = texts[at + len(words)].as_py()
                    words.append((x or "").encode().split())  # exactly at the six blanks of ASCII
                    n += len(words[-1])
                runs, collapsed = zip(*_group(words), strict=True)
                yield pa.RecordBatch.from_arrays([row.slice(at, len(words)), pa.array(runs, run_type), pa.array([c.decode() for c in collapsed], pa.string())], names=["row", "runs", "collapsed"])
                at += len(words)

    return rows.mapInArrow(work, schema)


def strongest(runs: str = "runs") -> F.Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
