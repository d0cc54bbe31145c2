"""Packed sorted runs of hashes: the shared machinery of window and shingle indexes.

A task hashes the words of its documents with numpy and emits, for each bucket
of the hash range, one row with a sorted array as bytes.  Rows are few and
arrays dense, so 100 million hashes travel in a few hundred MB.  Documents are
dealt out in chunks; a hash that many documents of a chunk share travels once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that a chunk is meant to hold.
PER_CHUNK = 128
#: Hashes that a bucket is meant to hold.
PER_BUCKET = 500_000
LEAST_BITS = 6

_word, _word_pair = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest


def chunk_bits(docs: DataFrame) -> int:
    """Bits for ``doc_id >> bits``, by which a smaller chunk has smaller doc_ids, with about PER_CHUNK documents a chunk.

    They come from the density of ids; where ids lie so unevenly that a chunk
    gets over eight times as many, fewer bits are taken, down to the 7 with
    which a chunk has no more ids than meant.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    least = PER_CHUNK.bit_length() - 1
    bits = max(least, int(math.log2(max(1.0, PER_CHUNK * (high - low + 1) / n)))) if n else least
    while bits > least:
        most = docs.groupBy(F.shiftright("doc_id", bits)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most <= 8 * PER_CHUNK:
            break
        bits = max(least, bits - 3)
    return bits


def size(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text."""
    rows, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return rows, total or 0


def bucket_bits(text_bytes: int, hashes_per_byte: float) -> int:
    """Bits of the bucket number, so that buckets stay the same size at any scale."""
    return max(LEAST_BITS, math.ceil(math.log2(max(1.0, text_bytes * hashes_per_byte / PER_BUCKET))))


def tokens(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between \\x20 and \\x09-\\x0D, as UTF-8."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_word, words), np.uint64, len(words))


def word_hash_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, the halves of one of 128 bits."""
    both = np.frombuffer(b"".join(map(_word_pair, words)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """A hash of each ``width`` consecutive numbers of h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(factor) + h[k : k + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    out = x[:n].copy()
    for k in range(1, width):
        np.minimum(out, x[k : k + n], out=out)
    return out


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def slices(ordered: np.ndarray, bits: int):
    """(bucket, from, to) of the buckets that a sorted array of hashes meets."""
    if not len(ordered):
        return
    bucket = (ordered >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
        yield int(bucket[a]), a, b


def gathered(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks in order, and of all runs the place of their chunk and their hashes."""
    own = np.asarray(table["chunk"])
    arrays = [np.frombuffer(b, dtype) for b in table["run"].to_pylist()]
    chunks, place = np.unique(own, return_inverse=True)
    return chunks, np.repeat(place, [len(a) for a in arrays]), np.concatenate(arrays) if arrays else np.empty(0, dtype)


def dealt(chunks: np.ndarray, place: np.ndarray):
    """(chunk, indexes) for each chunk that has any of the entries."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    at = place[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
        yield int(chunks[at[a]]), order[a:b]
