"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built on the driver over the normalised words of test items and accepts every run of words of any item; it is broadcast. A benchmark of more than
PART_CHARS characters is dealt to several automata (items longer than that in pieces that overlap by a window less a word), which are written to the shared folder.
A task then reads some texts (GROUP bytes), hashes their words once, and takes them through one automaton after the other, holding one at a
time. So the texts are read once and never rewritten, memory does not grow with the benchmark, and the result does not depend on the parts; an automaton is loaded
once for GROUP bytes of text. Training words are streamed through it; it tracks the length of
the longest run of item words that ends at each word. A window is `window` consecutive words of an item, or a
shorter item as a whole; every word inside an occurrence of a window is hit.

`find` reports hits, `clean` takes hit spans out of the texts, and drops documents of which more than a given share is hit.

Words: A to Z in lower case, then runs of 0-9, a-z and characters beyond ASCII.

Defined results: null and empty texts have no words and no hits; an item without words has no window; repeated
items each count by their item_id (repeated ids count once); an empty benchmark hits nothing; an empty table
gives an empty one; further columns stay (`clean`) or are left out (`find`); a null item_id counts as "null". The files of several automata stay in the shared
folder, as results are lazy.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import store
from granary.llm.common import checkpoint, importable, shared_dir
from granary.llm.text import ALNUM, runs, words

WINDOW = 10
#: Characters of the items of one automaton; it takes about 170 bytes for each on the driver while it is built.
PART_CHARS = 1_000_000
#: Bytes of the texts that go through several automata together.
GROUP = 32_000_000
FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_from array<int>, hit_to array<int>"


@dataclass
class Automaton:
    """States as arrays; `step` maps state * n_words + word id to the next state."""

    vocabulary: np.ndarray  # sorted hashes of item words; a word's id is its place
    pairs: np.ndarray  # sorted ids a * n + b of neighbouring item words
    step: dict[int, int]
    link: list[int]
    length: list[int]
    windows: dict[int, tuple[tuple[int, frozenset], ...]]  # state: windows that are its suffixes, as (length, items)
    shortest: int
    window: int


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> Automaton:
    hashes = []
    for _, text in items:
        for _, data, off in runs(pa.array([text], pa.string())):
            hashes.append(words(data, off, ALNUM)[0])
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    n = max(1, len(vocabulary))
    ids = [np.searchsorted(vocabulary, h).astype(np.int64) for h in hashes]
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[a[:-1] * n + a[1:] for a in ids if len(a) > 1]]))
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def add(last: int, w: int) -> int:
        """The state of the item read so far plus w; existing paths are shared between items."""
        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else split(last, w, q)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p != -1:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else split(p, w, q)
        return new

    def split(p: int, w: int, q: int) -> int:
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    for a in ids:
        last = 0
        for w in a.tolist():
            last = add(last, w)
    # Which items have which windows: walk each item once more and note its windows at the states that hold them.
    notes: dict[int, dict[int, set]] = {}
    for (name, _), a in zip(items, ids, strict=True):
        m = min(window, len(a))
        if not m:
            continue
        state = 0
        for i, w in enumerate(a.tolist()):
            state = step[state][w]
            while length[link[state]] >= m:
                state = link[state]
            if i >= m - 1:
                notes.setdefault(state, {}).setdefault(m, set()).add(name)
    below: dict[int, tuple] = {0: ()}
    for s in sorted(range(1, len(step)), key=lambda s: length[s]):
        own = tuple((m, frozenset(x)) for m, x in notes.get(s, {}).items())
        below[s] = own + below[link[s]]
    flat = {s * n + w: t for s, d in enumerate(step) for w, t in d.items()}
    shortest = min([window, *[len(a) for a in ids if len(a)]])
    return Automaton(vocabulary, pairs, flat, link, length, {s: x for s, x in below.items() if x}, shortest, window)


def hits(auto: Automaton, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
    """Which words are hit, and the items found in each text. Only runs of words whose neighbours all follow each other in some item can hold a window; just those are streamed."""
    hit = np.zeros(len(h) + 1, np.int32)
    items: dict[int, set] = {}
    n = max(1, len(auto.vocabulary))
    if not len(auto.vocabulary) or not len(h):
        return hit[:-1] > 0, items
    at = np.minimum(np.searchsorted(auto.vocabulary, h), n - 1)
    known = auto.vocabulary[at] == h
    ids = np.where(known, at, -1).astype(np.int64)
    joined = np.zeros(len(h), bool)  # the word goes on from the one before
    if len(h) > 1 and len(auto.pairs):
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        key = ids[both - 1] * n + ids[both]
        place = np.minimum(np.searchsorted(auto.pairs, key), len(auto.pairs) - 1)
        joined[both[auto.pairs[place] == key]] = True
    joined[off[:-1][off[:-1] < len(h)]] = False
    begin = np.flatnonzero(known & ~joined)
    end = np.concatenate([np.flatnonzero(~joined & (np.arange(len(h)) > 0)), [len(h)]])
    end = end[np.searchsorted(end, begin, "right")]
    last = np.concatenate([[0], np.cumsum(known)])
    long = (end - begin >= auto.shortest) & (last[end] - last[begin] == end - begin)
    step, link, length, window = auto.step, auto.link, auto.length, auto.window
    for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        doc = int(np.searchsorted(off, b, "right")) - 1
        state = 0
        size = 0
        for i, w in enumerate(ids[b:e].tolist(), b):
            while state and state * n + w not in step:
                state = link[state]
                size = length[state]
            state = step.get(state * n + w, 0)
            size = size + 1 if state else 0
            if size >= auto.shortest:
                for m, names in auto.windows.get(state, ()):
                    if m <= size:
                        hit[i + 1 - m] += 1
                        hit[i + 1] -= 1
                        items.setdefault(doc, set()).update(names)
    return np.cumsum(hit)[:-1] > 0, items


def pieces(benchmark: DataFrame, window: int, part_chars: int) -> DataFrame:
    """(item_id, text, n): each item, a longer one than half a part in pieces that overlap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for name, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(text) <= part_chars // 2:
                    out.append((name, text, 0))
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                _, starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
                at = 0
                while at < len(starts):
                    to = max(at + window, int(np.searchsorted(starts, starts[at] + part_chars // 2)))
                    out.append((name, data[starts[at] : ends[min(to, len(starts)) - 1]].tobytes().decode(), at))
                    at = len(starts) if to >= len(starts) else to - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [(), (), ()], (pa.string(), pa.string(), pa.int64()), strict=True)], names=["item_id", "text", "n"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where("text is not null")
    return rows.mapInArrow(work, "item_id string, text string, n long")


def automata(benchmark: DataFrame, window: int = WINDOW, part_chars: int = PART_CHARS) -> Iterator[tuple[Automaton, int]]:
    """(automaton, number of parts) of each part of the benchmark."""
    importable(benchmark.sparkSession)
    rows = pieces(benchmark, window, part_chars)
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = -(-size // part_chars) or 1
    if parts > 1:
        rows = checkpoint(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "n"), F.lit(parts))))
    for k in range(parts):
        mine = rows.where(F.col("part") == k) if parts > 1 else rows
        yield build([(r.item_id, r.text) for r in mine.select("item_id", "text").collect()], window), parts


def streamed(docs: DataFrame, benchmark: DataFrame, window: int, text: str, finish, schema, part_chars: int = PART_CHARS) -> DataFrame:
    """docs through all automata. Tasks hand each run of texts to `finish`: (batch of all columns, first row, bytes, offsets, starts and ends
    of the words, offsets in words, which words are hit, items of each text); what it yields are the rows."""
    place, spark = docs.columns.index(text), docs.sparkSession
    parts, folder, shared = 1, f"{shared_dir(spark).rstrip('/')}/automata-{uuid.uuid4().hex}", None
    for k, (auto, parts) in enumerate(automata(benchmark, window, part_chars)):
        if parts == 1:
            shared = spark.sparkContext.broadcast(auto)
        else:
            store.save(f"{folder}/{k}", {"automaton": np.frombuffer(pickle.dumps(auto, 5), np.uint8)})

    def groups(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        held, size = [], 0
        for at, data, off in runs(batch.column(place)):
            held.append((at, data, off, *words(data, off, ALNUM)))
            size += len(data)
            if parts == 1 or size >= GROUP:
                yield held
                held, size = [], 0
        if held:
            yield held

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch):
                found: list[tuple[np.ndarray, dict[int, set]]] = [(np.zeros(len(x[3]), bool), {}) for x in group]
                for k in range(parts):
                    auto = shared.value if shared else pickle.loads(store.load(f"{folder}/{k}")["automaton"].tobytes())
                    for (_, _, _, h, _, _, to), (hit, items) in zip(group, found, strict=True):
                        more, names = hits(auto, h, to)
                        hit |= more
                        for i, x in names.items():
                            items.setdefault(i, set()).update(x)
                for (at, data, off, _, starts, ends, to), (hit, items) in zip(group, found, strict=True):
                    yield from finish(batch.slice(at, len(off) - 1), data, off, starts, ends, to, hit, items)

    return docs.mapInArrow(work, schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_chars: int = PART_CHARS) -> DataFrame:
    """For each row of docs its digest columns and its hit spans [hit_from, hit_to) in words."""

    def finish(batch, data, off, starts, ends, to, hit, items) -> Iterator[pa.RecordBatch]:
        count = np.concatenate([[0], np.cumsum(hit)])
        n_hit = count[to[1:]] - count[to[:-1]]
        spans = [span(hit[a:b]) if n else ([], []) for a, b, n in zip(to[:-1], to[1:], n_hit, strict=True)]
        names = [sorted(items.get(i, ())) for i in range(len(off) - 1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(np.diff(to)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0),
                pa.array([x for x, _ in spans], pa.list_(pa.int32())), pa.array([x for _, x in spans], pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_from", "hit_to"],
        )

    return streamed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, "text", finish, FOUND, part_chars)


def span(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """docs without the hit spans, and without documents of which more than max_share of the words is hit. Null texts stay."""
    place = docs.columns.index(text)

    def finish(batch, data, off, starts, ends, to, hit, items) -> Iterator[pa.RecordBatch]:
        count = np.concatenate([[0], np.cumsum(hit)])
        n_hit = count[to[1:]] - count[to[:-1]]
        some = np.flatnonzero(n_hit).tolist()
        if some:
            texts, stay = batch.column(place).to_pylist(), np.ones(len(off) - 1, bool)
            for i in some:
                a, b = int(to[i]), int(to[i + 1])
                if n_hit[i] > max_share * (b - a):
                    stay[i] = False
                    continue
                kept, from_ = [], int(off[i])
                for x, y in zip(*span(hit[a:b]), strict=True):
                    kept.append(data[from_ : starts[a + x]].tobytes())
                    from_ = int(ends[a + y - 1])
                kept.append(data[from_ : off[i + 1]].tobytes())
                texts[i] = b"".join(kept).decode("utf-8", "replace")
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(stay))
        yield batch

    return streamed(docs, benchmark, window, text, finish, docs.schema, part_chars)
