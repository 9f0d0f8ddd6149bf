"""Word and shingle hashes, and bucketed packing of numpy tables into rows.

Words are the runs of bytes other than the six ASCII white-space bytes; the
lower-cased form changes A-Z alone. Hashes are 64-bit and the same in every
process. A packed row is (bucket, payload): a slice of a structured array, so
that millions of small records travel as a few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

_P = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 120_000
#: Fields that change little from record to record.
_RUNS = frozenset(("doc", "pos", "d1", "d2", "n", "df", "count", "words", "edges"))
_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied between texts when full."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] + np.uint64(salt)
    for j in range(1, k):
        out = out * _P + h[j : j + n]
    return mix(out)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter sequence is one shingle, none has none."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    if len(h) < k:
        return windows(h, len(h), salt=len(h))
    return np.unique(windows(h, k))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """96 bits of a sorted set: a signed long and 32 bits more."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist()
    return a, b & 0xFFFFFFFF


def pack(bucket: np.ndarray, table: np.ndarray, most: int = 1 << 18):
    """(bucket, payload) of each bucket's records in ``table``, split after ``most`` records.

    A payload holds the number of records, the fields' lengths, and one field
    after the other; those that repeat from record to record are compressed.
    """
    if not len(table):
        return [], []
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    fields = [np.ascontiguousarray(table[n][by]) for n in table.dtype.names]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist()
    names, payloads = [], []
    for lo, hi in zip(edges, edges[1:]):
        for at in range(lo, hi, most):
            names.append(int(bucket[lo]))
            blobs = [f[at : min(hi, at + most)].tobytes() for f in fields]
            if len(blobs[0]) > 512:
                blobs = [min(x, _ZSTD.compress(x), key=len) if n in _RUNS else x for n, x in zip(table.dtype.names, blobs)]
            head = np.array([min(hi, at + most) - at, *map(len, blobs)], "<u4").tobytes()
            payloads.append(head + b"".join(blobs))
    return names, payloads


def unpack(column, dtype) -> np.ndarray:
    """The records of a column of payloads."""
    payloads = column.to_pylist()
    heads = [np.frombuffer(p, "<u4", len(dtype.names) + 1).tolist() for p in payloads]
    out, at = np.empty(sum(h[0] for h in heads), dtype), 0
    for p, (n, *sizes) in zip(payloads, heads):
        skip = 4 * len(sizes) + 4
        for name, size in zip(dtype.names, sizes):
            blob = p[skip : skip + size]
            if size != n * dtype[name].itemsize:
                blob = _UNZSTD.decompress(blob)
            out[name][at : at + n] = np.frombuffer(blob, dtype[name])
            skip += size
        at += n
    return out


def packed_rows(kind: int, names: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(payloads, pa.binary())], names=["kind", "b", "payload"])


PACKED = "kind int, b int, payload binary"
