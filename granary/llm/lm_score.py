"""LM scoring with an Elias-Fano n-gram trie.

Training counts the words of the training documents (first pass), then their runs of three (second pass), and writes
a trie of three levels to the shared folder, cut by the first word into shards:

- words: the sorted hashes of a shard's training words as one Elias-Fano sequence, with exact counts; a word's id is its shard and its place there;
- pairs and triples: for each parent a monotone pointer (Elias-Fano) to its run of successors; successor ids are made
  monotone across runs by adding the last value of the run before, and stored as Elias-Fano; each n-gram has its
  smoothed probability and each parent the weight of its lower order, both in steps of 1/STEPS of a log10 in one byte; what is below the last
  step (8e-10) stands beside as a float, so no probability is raised to a floor.

A word with more than HOT occurrences is split: its successors are dealt by a hash over as many further shards as it has multiples of HOT, where they have a
parent of their own. Its pairs keep their share of the word's occurrences, and how many different successors it has in all shards is put together in a
table of such words, in shards as well. So no shard grows with one word's share of the corpus.

Smoothing is Witten-Bell: P(w | h) = (c(hw) + T(h) P(w | shorter h)) / (c(h) + T(h)), T(h) being the number of words seen after
h. The lowest order is (c + 0.1) / (N + 0.1 (V + 1)). Nothing is pruned. A document is preceded by a mark that is only context
and closed by an end that is predicted as a token.

Scoring maps the files, works on batches of documents and looks up each distinct pair and triple of a batch once, by a search
relative to the parent's run. A worker holds the shards it used last, OPEN of them and ROOM bytes at most of what is not mapped; the driver holds a few totals, no list of shards. Shuffled are n-grams that are counted
within a task first, one row for each shard and run of texts; a hot n-gram is one entry of it. Shards hold about SHARD_CHARS characters' n-grams, whatever the
input's size. The shared folder should be mounted on the workers; where it is not, shards are read whole.

Words: A to Z in lower case, then runs of anything but space and \\t to \\r; told by a 64-bit hash.

Defined results: a null or empty text is the end alone; a null id is not learnt from and counts as held out;
repeated rows are each counted and scored; without training documents all words are unknown (N = V = 0); an
empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import store
from granary.llm.common import MAX_PARTS, by_number, checkpoint, dealt, importable, shared_dir
from granary.llm.elias_fano import EliasFano
from granary.llm.text import mix, runs, words

FOLDS, STEPS = 10, 28
SHARD_CHARS, TOKENS = 8_000_000, 1_000_000
#: Occurrences of a first word from which its successors are dealt over several shards.
HOT = 500_000
#: Shards that a worker holds open, and bytes of those that it had to read; pages of mapped files come and go by themselves.
OPEN, ROOM = 10_000, 200_000_000
END = np.uint64(0xE0D0E0D0E0D0E0D1)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


#: The code of a probability that is too small for a step: it stands in a list beside the codes.
SMALL = 255
#: Probability of each other code.
DECODED = 10.0 ** (-np.arange(SMALL + 1) / STEPS)


def coded(name: str, p: np.ndarray) -> dict[str, np.ndarray]:
    """Probabilities in steps, in a byte each; those below the last step by their place, as floats."""
    codes = np.minimum(np.rint(-np.log10(p) * STEPS), SMALL).astype(np.uint8)
    small = np.flatnonzero(codes == SMALL)
    return {name: codes, f"{name}_at": small, f"{name}_small": p[small].astype(np.float32)}


class Codes:
    """What `coded` has stored."""

    def __init__(self, x: dict[str, np.ndarray], name: str):
        self.codes, self.at, self.small = x[name], x[f"{name}_at"], x[f"{name}_small"]

    def __getitem__(self, place: np.ndarray) -> np.ndarray:
        codes = self.codes[place]
        out = DECODED[codes]
        some = np.flatnonzero(codes == SMALL)
        if len(some):
            out[some] = self.small[np.searchsorted(self.at, place[some])]
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by END; offsets of the texts among them."""
    h, _, _, to = words(data, offsets)
    return np.insert(h, to[1:], END), to + np.arange(len(to))


def token_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets) of consecutive texts with about TOKENS tokens."""
    first, held, size = 0, [], 0
    for at, data, off in runs(column):
        h, to = tokens(data, off)
        if not held:
            first = at
        held.append((h, to + size))
        size += len(h)
        if size >= TOKENS:
            yield first, np.concatenate([x for x, _ in held]), np.concatenate([held[0][1][:1], *[x[1:] for _, x in held]])
            held, size = [], 0
    if held:
        yield first, np.concatenate([x for x, _ in held]), np.concatenate([held[0][1][:1], *[x[1:] for _, x in held]])


def training(batch: pa.RecordBatch) -> pa.Array:
    keep = pa.array([not is_held_out(d) for d in batch.column(0).to_pylist()], pa.bool_())
    return batch.column(1).filter(keep)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_shards: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(sorted_shards, np.arange(shards + 1))


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts as bytes where they fit, else as 8-byte integers."""
    return x.astype(np.uint8) if not len(x) or x.max() < 256 else x.astype(np.uint64)


def widened(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if len(blob) == n else np.uint64).astype(np.int64)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n[:0]


@dataclass(frozen=True)
class Totals:
    """Of the training documents: shards, bits of a place in a shard, distinct words, tokens, documents, words of shard 0, and what a hot word is."""

    shards: int
    bits: int
    V: int
    N: int
    docs: int
    first: int
    hot: int

    @property
    def mark(self) -> int:
        """Id of the mark before a document: the place after shard 0's words."""
        return self.first

    @property
    def width(self) -> int:
        """Bytes of an id; one value is left over."""
        return -(-(self.id_bits + 1) // 8)

    @property
    def id_bits(self) -> int:
        return self.bits + (self.shards - 1).bit_length()

    def place(self, u: np.ndarray) -> np.ndarray:
        return u & ((1 << self.bits) - 1)

    def parts(self, count: np.ndarray) -> np.ndarray:
        """Shards over which words with so many occurrences are dealt."""
        return 1 + count // self.hot

    def shard(self, u: np.ndarray, v: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Where the run (u, v) is; count: occurrences of u."""
        out = u >> self.bits
        parts = self.parts(count)
        some = np.flatnonzero(parts > 1)
        out[some] = (out[some] + (mix(v[some].astype(np.uint64)) % parts[some].astype(np.uint64)).astype(np.int64)) % self.shards
        return out


class Recent:
    """What was loaded last; None for what isn't there."""

    def __init__(self, load: Callable):
        self.load, self.held, self.size = load, OrderedDict(), 0

    def __getitem__(self, s: int):
        if s in self.held:
            self.held.move_to_end(s)
            return self.held[s][0]
        try:
            x, size = self.load(s)
        except FileNotFoundError:
            x, size = None, 0
        self.held[s] = x, size
        self.size += size
        while (self.size > ROOM or len(self.held) > OPEN) and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1][1]
        return x


def opened(uri: str) -> tuple[dict[str, np.ndarray], int]:
    """Arrays of a file and the bytes of memory they take."""
    x = store.load(uri)
    return x, 0 if store.is_mapped(uri) else sum(a.nbytes for a in x.values())


def grouped(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of each shard that occurs."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0]))
    for a, b in zip(at, [*at[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


class Words:
    """First level: ids and counts of all training words."""

    def __init__(self, base: str, shards: int, bits: int):
        self.base, self.n, self.bits = base, shards, bits
        self.shards = Recent(self.load)

    def load(self, s: int):
        x, size = opened(f"{self.base}/words-{s}")
        return (EliasFano.of(x), x["counts"]), size

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words: ids (-1: unknown), rising as their hashes do, and counts; and which of them each word is."""
        distinct, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        for s, at in grouped(shard_of(distinct, self.n)):
            if self.shards[s]:
                seq, n = self.shards[s]
                place = seq.find(distinct[at])
                known = place >= 0
                ids[at] = np.where(known, (s << self.bits) | place, -1)
                counts[at[known]] = n[place[known]]
        return ids, counts, back

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for s, at in grouped(ids >> self.bits):
            out[at] = self.shards[s][1][ids[at] & ((1 << self.bits) - 1)]
        return out


class Level:
    """Successors of the parents 0 .. n-1 with their codes, and the weight codes of the parents."""

    def __init__(self, x: dict[str, np.ndarray], name: str):
        self.names = x.get("names", np.zeros(0, np.int64))
        self.pointers, self.successors = EliasFano.of(x, f"{name}p"), EliasFano.of(x, f"{name}s")
        self.prob, self.weight = Codes(x, f"{name}codes"), Codes(x, f"{name}weights")

    @staticmethod
    def arrays(name: str, parents: int, parent: np.ndarray, word: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """parent and word rise together."""
        pointers = np.searchsorted(parent, np.arange(parents + 1))
        ends = pointers[1:][np.diff(pointers) > 0]
        # what each run adds: the last value of the run before, in monotone form
        base = np.concatenate([[0], np.cumsum(word[ends - 1] + 1)]) if len(ends) else np.zeros(1, np.int64)
        run = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends]))) if len(ends) else np.zeros(0, np.int64)
        out = coded(f"{name}codes", prob) | coded(f"{name}weights", weight)
        return out | EliasFano.build(pointers).arrays(f"{name}p") | EliasFano.build(base[run] + word + 1).arrays(f"{name}s")

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the words among their parents' successors, or -1: a search from what the run before ends with."""
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, word), len(self.names) - 1)
            word, known = at, self.names[at] == word
            parent, whole = parent[known], np.full(len(known), -1, np.int64)
            whole[known] = self._find(parent, word[known])
            return whole
        return self._find(parent, word)

    def _find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        begin, end = self.pointers.get(parent).astype(np.int64), self.pointers.get(parent + 1).astype(np.int64)
        out = np.full(len(parent), -1, np.int64)
        some = np.flatnonzero(begin < end)
        base = np.zeros(len(some), np.uint64)
        later = begin[some] > 0
        base[later] = self.successors.get(begin[some][later] - 1)
        place = self.successors.find(base + word[some].astype(np.uint64) + np.uint64(1))
        out[some] = np.where((place >= begin[some]) & (place < end[some]), place, -1)
        return out


class Trie:
    def __init__(self, base: str, totals: Totals):
        self.base, self.t, self.words = base, totals, Words(base, totals.shards, totals.bits)
        self.shards = Recent(self.load)
        self.hot = Recent(lambda s: opened(f"{base}/hot-{s}"))

    def load(self, s: int):
        x, size = opened(f"{self.base}/runs-{s}")
        return (int(x["own"][0]), x["foreign"], Level(x, "pair"), Level(x, "triple")), size

    def parents(self, s: int, u: np.ndarray) -> np.ndarray:
        """Places of u among the parents of a shard, or -1."""
        own, foreign, _, _ = self.shards[s]
        at = np.searchsorted(foreign, u)
        there = np.zeros(len(u), bool)
        there[at < len(foreign)] = foreign[at[at < len(foreign)]] == u[at < len(foreign)]
        return np.where(u >> self.t.bits == s, self.t.place(u), np.where(there, own + at, -1))

    def kinds(self, u: np.ndarray) -> np.ndarray:
        """Different successors of hot words."""
        out = np.zeros(len(u), np.int64)
        for s, at in grouped(u >> self.t.bits):
            hot = self.hot[s]
            out[at] = hot["kinds"][np.searchsorted(hot["u"], u[at])]
        return out

    def score(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: known, base and model log10 probability."""
        t = self.t
        names, counts, word = self.words.of(h)
        low = ((counts + 0.1) / (t.N + 0.1 * (t.V + 1)))[word]
        base = np.log10(low)
        # by their place in the batch: the words, and those before; before a document the mark
        n = len(names) + 1
        names, counts = np.append(names, t.mark if t.docs else -1), np.append(counts, t.docs)
        before = np.concatenate([[0], word[:-1]])
        before[off[:-1]] = n - 1
        seen, after_seen = (names >= 0)[word], (names >= 0)[before]
        p = low.copy()
        # distinct pairs of known words
        pair = np.flatnonzero(seen & after_seen)
        distinct, back = np.unique(before[pair] * n + word[pair], return_inverse=True)
        u, v, c = names[distinct // n], names[distinct % n], counts[distinct // n]
        hit, weight, prob = np.full(len(u), -1, np.int64), np.ones(len(u)), np.zeros(len(u))
        onward = np.ones(len(u))  # weight of the lower order after the pair
        shard = t.shard(u, v, c)
        for s, at in grouped(shard):
            if self.shards[s] is None:
                continue
            _, _, pairs, triples = self.shards[s]
            parent = self.parents(s, u[at])
            at, parent = at[parent >= 0], parent[parent >= 0]
            place = hit[at] = pairs.find(parent, v[at])
            weight[at] = pairs.weight[parent]
            known = place >= 0
            prob[at[known]] = pairs.prob[place[known]]
            onward[at[known]] = triples.weight[place[known]]
        split = np.flatnonzero(t.parts(c) > 1)
        if len(split):  # shares of the occurrences, not yet of occurrences and kinds
            kinds = self.kinds(u[split])
            prob[split] *= c[split] / (c[split] + kinds)
            weight[split] = kinds / (c[split] + kinds)
        p[pair] = prob[back] + weight[back] * low[pair]
        # an unknown word after a known one still pays the weight
        lone = np.flatnonzero(~seen & after_seen)
        if len(lone):
            p[lone] *= self.weights(names[before[lone]], counts[before[lone]])
        # triples: the pair before this token is the pair that ends at the token before
        of_token = np.full(len(h), -1, np.int64)
        of_token[pair] = back
        start = np.zeros(len(h), bool)
        start[off[:-1]] = True
        cand = np.flatnonzero(~start & (np.concatenate([[-1], of_token[:-1]]) >= 0))
        context = of_token[cand - 1]
        ok = hit[context] >= 0
        cand, context = cand[ok], context[ok]
        lower = p[cand] * onward[context]
        known = seen[cand]
        extra = np.zeros(len(cand))
        if known.any():
            distinct, back = np.unique(context[known] * n + word[cand[known]], return_inverse=True)
            c, third = distinct // n, names[distinct % n]
            got = np.zeros(len(c))
            for s, at in grouped(shard[c]):
                triples = self.shards[s][3]
                place = triples.find(hit[c[at]], third[at])
                there = place >= 0
                got[at[there]] = triples.prob[place[there]]
            extra[known] = got[back]
        p[cand] = lower + extra
        return seen, base, np.log10(p)

    def weights(self, u: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Weight of the lower order after each word."""
        distinct, first, back = np.unique(u, return_index=True, return_inverse=True)
        c = count[first]
        out = np.ones(len(distinct))
        split = self.t.parts(c) > 1
        kinds = self.kinds(distinct[split])
        out[split] = kinds / (c[split] + kinds)
        single = np.flatnonzero(~split)
        for s, at in grouped(distinct[single] >> self.t.bits):
            if self.shards[s]:
                out[single[at]] = self.shards[s][2].weight[self.t.place(distinct[single[at]])]
        return out[back]


def planes(x: np.ndarray, width: int) -> bytes:
    """All first bytes, then all second ones, up to `width`: high bytes are mostly alike and compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, :width] = x.T
    return out.view("<u8").reshape(-1).astype(np.int64)


def count_words(docs: DataFrame, base: str, shards: int, hot: int, parts: int = MAX_PARTS) -> Totals:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, _ in token_runs(training(batch)):
                h, n = np.unique(h, return_counts=True)
                at = cuts(shard_of(h, shards), shards)
                some = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array([f(x[at[s] : at[s + 1]]).tobytes() for s in some], pa.binary()) for x, f in ((h, np.asarray), (n, narrow))]], names=["shard", "h", "n"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in by_number(batches, shards > parts):
            h = [np.frombuffer(x, np.uint64) for x, _ in rows]
            key, n = summed(np.concatenate(h), np.concatenate([widened(y, len(x)) for x, (_, y) in zip(h, rows, strict=True)]))
            seq = EliasFano.build(key)
            store.save(f"{base}/words-{s}", seq.arrays() | {"counts": n.astype(np.uint32) if n.max() < 2**32 else n})
            row = (s, len(key), int(n.sum()), int(n[key == END].sum()))
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *[pa.array([x]) for x in row[1:]]], names=["shard", "v", "n", "ends"])

    rows = dealt(docs.mapInArrow(gather, "shard int, h binary, n binary"), "shard", shards, parts).mapInArrow(reduce, "shard int, v long, n long, ends long")
    x = rows.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.max("v").alias("most"), F.sum("ends").alias("docs"), F.max(F.when(F.col("shard") == 0, F.col("v"))).alias("first")).first()
    return Totals(shards, ((x.most or 0) + 1).bit_length(), x.v or 0, x.n or 0, x.docs or 0, x["first"] or 0, hot)


def count_runs(docs: DataFrame, base: str, t: Totals, parts: int = MAX_PARTS) -> None:
    """Writes the pairs and triples of each shard, and the table of hot words."""
    nothing = (1 << 8 * t.width) - 1

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words(base, t.shards, t.bits)
        for batch in batches:
            for _, h, to in token_runs(training(batch)):
                names, counts, w = vocabulary.of(h)
                names, counts = np.append(names, t.mark), np.append(counts, t.docs)
                n = len(names) + 1
                u = np.concatenate([[0], w[:-1]])
                u[to[:-1]] = n - 2
                after = np.concatenate([w[1:], [0]])
                after[to[1:] - 1] = n - 1  # nothing follows the end
                # runs (u, w, after) as two sorted keys
                pair, back = np.unique(u * n + w, return_inverse=True)
                key, times = np.unique(back * n + after, return_counts=True)
                of = key // n
                u, v = names[pair // n], names[pair % n]
                shard = t.shard(u, v, counts[pair // n])[of]
                order = np.argsort(shard, kind="stable")
                last = key % n
                columns = [u[of], v[of], np.where(last == n - 1, nothing, names[np.minimum(last, n - 2)])]
                at = cuts(shard[order], t.shards)
                some = np.flatnonzero(np.diff(at)).tolist()
                blobs = [pa.array([planes(x[order[at[s] : at[s + 1]]], t.width) for s in some], pa.binary()) for x in columns]
                blobs.append(pa.array([narrow(times[order[at[s] : at[s + 1]]]).tobytes() for s in some], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *blobs], names=["shard", "u", "v", "w", "n"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words(base, t.shards, t.bits)
        for s, rows in by_number(batches, t.shards > parts):
            n = np.concatenate([widened(r[3], len(r[0]) // t.width) for r in rows])
            u = np.concatenate([from_planes(r[0], t.width) for r in rows])
            mine = vocabulary.shards[s]
            own = (mine[0].n if mine else 0) + 1  # and the mark, which is shard 0's
            foreign = np.unique(u[u >> t.bits != s])
            parent = np.where(u >> t.bits == s, t.place(u), own + np.searchsorted(foreign, u))
            del u
            second, w = (np.concatenate([from_planes(r[k], t.width) for r in rows]) for k in (1, 2))
            del rows
            bits, none, names = t.id_bits, nothing, {}
            if (len(n) + own + len(foreign)).bit_length() + bits > 63:  # sums of as many ids don't fit: words by their number in the shard
                kept = np.unique(np.concatenate([second, w[w != nothing]]))
                second, w = np.searchsorted(kept, second), np.where(w == nothing, len(kept), np.searchsorted(kept, w))
                bits, none, names = len(kept).bit_length(), len(kept), {"names": kept}
            pair = parent << bits | second
            del parent, second
            order = np.lexsort((w, pair))
            pair, w, n = pair[order], w[order], n[order]
            del order
            start = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (w[1:] != w[:-1])]))
            pair, w, n = pair[start], w[start], np.add.reduceat(n, start)
            first_of = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            total = np.add.reduceat(n, first_of)
            pairs = pair[first_of]
            index = np.repeat(np.arange(len(pairs)), np.diff(np.concatenate([first_of, [len(pair)]])))
            # triples
            real = w != none
            kinds = np.bincount(index[real], minlength=len(pairs))
            mass = total + kinds
            triples = Level.arrays("triple", len(pairs), index[real], w[real], n[real] / mass[index[real]], np.where(kinds > 0, kinds / mass, 1.0))
            # pairs: of split parents as shares of all their occurrences
            parents = own + len(foreign)
            parent, seconds = pairs >> bits, pairs & ((1 << bits) - 1)
            occurs = np.zeros(parents, np.int64)
            if mine:
                occurs[: own - 1] = mine[1]
            if s == 0:
                occurs[own - 1] = t.docs
            elsewhere = foreign != t.mark
            occurs[own:][elsewhere] = vocabulary.counts(foreign[elsewhere])
            occurs[own:][~elsewhere] = t.docs
            split = t.parts(occurs) > 1
            kinds = np.bincount(parent, minlength=parents)
            mass = np.where(split, occurs, np.bincount(parent, weights=total, minlength=parents) + kinds)
            share = np.divide(kinds, mass, out=np.ones(parents), where=(kinds > 0) & ~split)
            level = Level.arrays("pair", parents, parent, seconds, total / mass[parent], share)
            store.save(f"{base}/runs-{s}", {"own": np.array([own]), "foreign": foreign} | names | level | triples)
            hot = np.flatnonzero(split & (kinds > 0))
            ids = np.where(hot < own, s << t.bits | hot, foreign[np.maximum(hot - own, 0)] if len(foreign) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds[hot], pa.int64())], names=["u", "kinds"])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in by_number(batches, t.shards > parts):
            rows.sort()
            store.save(f"{base}/hot-{s}", {"u": np.array([u for u, _ in rows], np.int64), "kinds": np.array([k for _, k in rows], np.int64)})
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)])], names=["words"])

    rows = dealt(docs.mapInArrow(gather, "shard int, u binary, v binary, w binary, n binary"), "shard", t.shards, parts).mapInArrow(reduce, "u long, kinds long")
    hot = rows.groupBy("u").agg(F.sum("kinds").alias("kinds")).select(F.shiftright("u", t.bits).cast("int").alias("shard"), "u", "kinds")
    dealt(hot, "shard", t.shards, parts).mapInArrow(table, "words long").agg(F.sum("words")).collect()


def score(docs: DataFrame, hot: int = HOT, parts: int = MAX_PARTS) -> DataFrame:
    """Learn from the training documents and score all. The trie's files go with the checkpoint folder's other content once the scores are there."""
    importable(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(16, -(-chars // SHARD_CHARS))
    base = f"{shared_dir(docs.sparkSession).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    totals = count_words(docs, base, shards, hot, parts)
    count_runs(docs, base, totals, parts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(base, totals)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, h, to in token_runs(batch.column(1)):
                known, low, high = trie.score(h, to)
                n = len(to) - 1
                sums = [np.add.reduceat(x, to[:-1]) for x in (known.astype(np.int64), low, high)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), pa.array([is_held_out(d) for d in ids[at : at + n]]), pa.array(np.diff(to)), pa.array(sums[0]),
                        pa.array(np.full(n, totals.N, np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = checkpoint(docs.mapInArrow(work, SCORED))
    store.remove(base)
    return out
