"""Content-defined chunks, their codecs and envelopes.

The rolling hash shifts by a bit and adds a value drawn for each byte, so its low b bits depend on the last b bytes only. Cuts
can so be found for a whole stream at once: bit k of the hash is a sum over the last k + 1 bytes, worked out with k + 1 shifted additions,
and only the walk from cut to cut is a loop. The table of 256 values is drawn from a rule.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.blake3 import blake3, digest_column
from granary.session import importable

MIN, AVERAGE, MAX = 512 << 10, 2 << 20, 8 << 20
#: Bytes of streams whose chunks are handed on together.
BATCH_BYTES = 4_000_000


def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = _table()


def check_sizes(low: int, average: int, high: int) -> None:
    if not 0 < low <= average <= high:
        raise ValueError("sizes must rise: 0 < min <= average <= max")


def cuts(data: bytes, low: int = MIN, average: int = AVERAGE, high: int = MAX) -> list[int]:
    """Ends of the chunks. A chunk is cut after byte i if i is at least half the average, the bytes from the minimum
    up to i give a hash whose low bits are zero, at the maximum, or at the end; what is no longer than the minimum is one chunk."""
    check_sizes(low, average, high)
    bits = max(0, (average - 1).bit_length())
    mask = np.uint64((1 << bits) - 1)
    value = TABLE[np.frombuffer(data, np.uint8)]
    full = value.copy()  # hash over the last `bits` bytes
    for k in range(1, bits):
        full[k:] += value[:-k] << np.uint64(k)
    zero = np.flatnonzero((full & mask) == 0)
    ends, at, n = [], 0, len(data)
    while at < n:
        if n - at <= low:
            ends.append(n)
            break
        top = min(n, at + high)
        cut = top
        # near the start the hash covers fewer bytes than its width
        first = at + low
        for i in range(max(first, at + average // 2), min(first + bits, top)):
            h = np.uint64(0)
            for j in range(first, i + 1):
                h = np.uint64((int(h) << 1) + int(value[j]) & 0xFFFFFFFFFFFFFFFF)
            if h & mask == 0:
                cut = i + 1
                break
        else:
            k = np.searchsorted(zero, max(first + bits, at + average // 2))
            if k < len(zero) and zero[k] < top:
                cut = int(zero[k]) + 1
        ends.append(cut)
        at = cut
    return ends


#: Digests that name contents.
DIGESTS = ("sha256", "blake3")


def _digests(parts: list, algo: str) -> list[str]:
    if algo == "blake3":
        return digest_column(pa.array(parts, pa.large_binary()))
    return [hashlib.sha256(p).hexdigest() for p in parts]


def content_id(data: Column, algo: Column) -> Column:
    """The content id by its `algo`, sha256 or blake3; null for any other."""
    return F.when(algo == "sha256", F.sha2(data, 256)).when(algo == "blake3", blake3(data))


def chunks(df: DataFrame, key: str, data: str, low: int = MIN, average: int = AVERAGE, high: int = MAX, algo: str | None = None) -> DataFrame:
    """Chunks of each row's stream: (key, sequence, offset, size, data), or with `algo` their content ids instead of the bytes: (key, sequence, offset, size, hash, algo).

    The ids are worked out where the chunks are cut, so that what is decided on them moves no bytes of the streams."""
    check_sizes(low, average, high)
    if algo not in (None, *DIGESTS):
        raise ValueError(f"unknown digest {algo}")
    importable(df.sparkSession)
    columns = ["key", "sequence", "offset", "size", *(["hash", "algo"] if algo else ["data"])]

    def rows(keys: list, places: list, starts: list, sizes: list, parts: list) -> pa.RecordBatch:
        values = [keys, places, starts, sizes, *([_digests(parts, algo), [algo] * len(parts)] if algo else [parts])]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *([pa.string(), pa.string()] if algo else [pa.binary()])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, kinds, strict=True)], names=columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, starts, sizes, parts, held = [], [], [], [], [], 0
            for k, d in zip(*batch.columns, strict=True):
                k, d = k.as_py(), d.as_py()
                ends = cuts(d, low, average, high) if d is not None else []
                first = [0, *ends][: len(ends)]
                keys += [k] * len(ends)
                places += range(len(ends))
                starts += first
                sizes += [b - a for a, b in zip(first, ends, strict=True)]
                parts += [d[a:b] for a, b in zip(first, ends, strict=True)]
                held += len(d or b"")
                if held > BATCH_BYTES:
                    yield rows(keys, places, starts, sizes, parts)
                    keys, places, starts, sizes, parts, held = [], [], [], [], [], 0
            yield rows(keys, places, starts, sizes, parts)

    schema = "key string, sequence int, offset long, size long, " + ("hash string, algo string" if algo else "data binary")
    return df.select(F.col(key).cast("string").alias("key"), F.col(data).cast("binary").alias("data")).mapInArrow(work, schema)


@F.pandas_udf(T.BinaryType())
def compressed(data: pd.Series, algorithm: pd.Series) -> pd.Series:
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    return pd.Series([None if d is None else d if a == "none" else zlib.compress(d, wbits=31) if a == "gzip" else pack(d) for d, a in zip(data, algorithm, strict=True)])


@F.pandas_udf(T.BinaryType())
def decompressed(data: pd.Series, algorithm: pd.Series) -> pd.Series:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return pd.Series([None if d is None else d if a == "none" else zlib.decompress(d, wbits=31) if a == "gzip" else unpack(d) for d, a in zip(data, algorithm, strict=True)])


@F.pandas_udf(T.BinaryType())
def try_decompressed(data: pd.Series, algorithm: pd.Series) -> pd.Series:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress

    def one(d, a):
        try:
            return None if d is None else d if a == "none" else zlib.decompress(d, wbits=31) if a == "gzip" else unpack(d)
        except (zlib.error, zstandard.ZstdError):
            return None

    return pd.Series([one(d, a) for d, a in zip(data, algorithm, strict=True)])


# Fixed values of the envelope: its first bytes, version and number of the cipher.
MAGIC, VERSION, AES_GCM = b"GRNE", 1, 1


def header(key_id: Column, nonce: Column) -> Column:
    """Magic, version, cipher, length of nonce, length of key id (two bytes), nonce, key id."""
    name = key_id.cast("binary")
    byte = lambda n, width: F.unhex(F.lpad(F.hex(n), 2 * width, "0"))
    return F.concat(F.lit(MAGIC), byte(F.lit(VERSION), 1), byte(F.lit(AES_GCM), 1), byte(F.length(nonce), 1), byte(F.length(name), 2), nonce, name)


def sealed(data: Column, key: Column, key_id: Column, nonce: Column, digest: Column) -> Column:
    """Header and ciphertext; header and digest are authenticated. nonce: 12 bytes, used once with a key."""
    head = header(key_id, nonce)
    return F.concat(head, F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, F.concat(head, digest)))


def opened(envelope: Column, key: Column, digest: Column) -> Column:
    """The plain bytes; fails on any change of header, digest or ciphertext."""
    body, head = _split(envelope)
    return F.aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(head, digest))


def try_plain(envelope: Column, algorithm: Column, key: Column, digest: Column) -> Column:
    """The plain, decompressed bytes, or null where anything was changed."""
    body, head = _split(envelope)
    return try_decompressed(F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(head, digest)), algorithm)


def _split(envelope: Column) -> tuple[Column, Column]:
    number = lambda at, n: F.conv(F.hex(F.substring(envelope, at, n)), 16, 10).cast("int")
    nonce_length, name_length = number(7, 1), number(8, 2)
    size = F.lit(9) + nonce_length + name_length
    return F.substring(envelope, size + 1, F.length(envelope)), F.substring(envelope, F.lit(1), size)
