"""Words and shingles of whole batches of texts, as arrays of 64-bit hashes.

A batch is worked on as one byte array: a table maps each byte (lower case, separators to spaces), and a word's
hash comes from differences of one running polynomial sum. Such sums, modulo a power of two, meet for long words of certain patterns
(1,024 bytes and more), so words of more than LONG_WORD bytes are hashed by their bytes instead. Different words or shingles that share a hash are
taken for equal; for n of them that has odds of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of the longest word whose hash is a polynomial sum.
LONG_WORD = 255
#: Texts are worked on in runs of about so many bytes (a longer text is a run of its own).
RUN = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def byte_table(separators, lower: bool = True) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 32
    return t


#: Words are runs of anything but space and \t to \r, in lower case (A to Z only).
SPACED = byte_table([32, *range(9, 14)])
#: Words are runs of 0-9, a-z and what is not ASCII.
ALNUM = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1 << 20, 1 << (n - 1).bit_length()) if n else 1)[:n]


def runs(column: pa.Array, size: int = RUN) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(a):
        return
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the offsets of the texts in words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, np.zeros(len(offsets), np.int64)
    b = table[data]
    solid = b != 32
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    h = mix((total[ends] - total[starts]) * powers(INVERSE, n)[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(b[starts[i] : ends[i]], seed=LONG_WORD)
    return h, starts, ends, np.searchsorted(starts, offsets)


def shingles(h: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words in each text, and the texts' offsets among them. A shorter text that has words is one window."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(to[-1]), np.uint64)
    full = n >= size
    # first word of each window
    row = np.repeat(np.arange(len(n)), count)
    first = offsets[:-1][row] + np.arange(len(row)) - to[:-1][row]
    long = full[row]
    f = first[long]
    x = np.zeros(len(f), np.uint64)
    for k in range(size):
        x = x * np.uint64(0xD6E8FEB86659FD93) + h[f + k]
    out[long] = mix(x)
    for i in np.flatnonzero(~full & (n > 0)):
        x = int(n[i])
        for k in range(offsets[i], offsets[i + 1]):
            x = (x * 0xD6E8FEB86659FD93 + int(h[k])) % 2**64
        out[to[i]] = mix(np.array([x ^ 0x5851F42D4C957F2D], np.uint64))[0]
    return out, to
