"""Substring deduplication by a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .common import Levels, cut, looked_up, small_batches

WINDOW = 13
GRAM = 5
FIRST, SECOND, SMALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Chunks: the batches of the log. ``age`` is the smallest doc_id that a chunk can hold; ``sub`` tells apart chunks of one doc_id.
CHUNK = ["age", "sub"]
#: Bytes of text above which, as above 8 * PER_CHUNK rows, a chunk is cut into its doc_ids, and these by rows.
CHUNK_BYTES = 64 << 20
RUN = "bucket int, run binary"
CHUNK_RUN = "bucket int, age bigint, sub int, run binary"
BACK = "age bigint, sub int, run binary"
#: A window by two independent hashes of its words: the first is sorted on, both are compared.
FINGERPRINT = np.dtype([("first", "<u8"), ("second", "<u8")])
#: The age of history, older than any chunk.
OLDEST = -(1 << 63)


def _windows(pair: tuple[np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """The fingerprint of each window, from the words' pairs of hashes."""
    first, second = runs.rolling(pair[0], window, FIRST), runs.rolling(pair[1], window, SECOND)
    out = np.empty(len(first), FINGERPRINT)
    out["first"], out["second"] = first, second
    return out


def _sorted(f: np.ndarray) -> np.ndarray:
    """Fingerprints in order, each once."""
    f = f[np.lexsort((f["second"], f["first"]))]
    return f[_changes(f)]


def _changes(f: np.ndarray) -> np.ndarray:
    """Where a fingerprint of a sorted array differs from the one before."""
    return np.r_[True, (f["first"][1:] != f["first"][:-1]) | (f["second"][1:] != f["second"][:-1])] if len(f) else np.empty(0, bool)


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """For each window the smallest hash of its GRAM-word grams; equal windows have equal anchors."""
    gram = min(GRAM, window)
    if len(h) < window:
        return np.empty(0, np.uint64)
    return runs.mix(runs.sliding_min(runs.rolling(h, gram, SMALL), window - gram + 1))


def _out(rows: list[tuple], schema: pa.Schema):
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_RUN = pa.schema([("bucket", pa.int32()), ("age", pa.int64()), ("sub", pa.int32()), ("run", pa.binary())])
_BACK = pa.schema([("age", pa.int64()), ("sub", pa.int32()), ("run", pa.binary())])


def _gathered(table: pa.Table, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks in order of age, and of all runs the place of their chunk and their hashes."""
    own = np.empty(len(table), np.dtype([("age", "<i8"), ("sub", "<i4")]))
    own["age"], own["sub"] = np.asarray(table["age"]), np.asarray(table["sub"])
    arrays = [np.frombuffer(b, dtype) for b in table["run"].to_pylist()]
    chunks, place = np.unique(own, return_inverse=True)
    return chunks, np.repeat(place, [len(a) for a in arrays]), np.concatenate(arrays) if arrays else np.empty(0, dtype)


def _dealt(chunks: np.ndarray, place: np.ndarray, values: np.ndarray) -> pa.Table:
    """Values back to the chunks of their places."""
    number = runs.dealt(np.arange(len(chunks)), place)
    return _out([(int(chunks["age"][c]), int(chunks["sub"][c]), values[i].tobytes()) for c, i in number], _BACK)


def _anchor_runs(window: int, bits: int):
    def flush(key, docs):
        """The anchors of a chunk's windows, each once, as a sorted run a bucket."""
        found = [np.unique(_anchors(runs.word_hash_pairs(runs.tokens(t))[0], window)) for t in docs["text"].to_pylist()]
        own = np.unique(np.concatenate(found))
        return _out([(b, key[0].as_py(), key[1].as_py(), own[i:j].tobytes()) for b, i, j in runs.slices(own, bits)], _RUN)

    return flush


def _merge_anchors(key, table):
    """Anchors that two chunks share, back to each of their chunks."""
    chunks, place, h = _gathered(table, np.uint64)
    order = np.lexsort((place, h))
    h, place = h[order], place[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    ends = np.r_[starts[1:], len(h)]
    shared = np.repeat(place[starts] != place[ends - 1], ends - starts)
    return _dealt(chunks, place[shared], h[shared])


def _flushed(age: int | None, sub: int | None, found: list[np.ndarray], bits: int) -> pa.Table:
    """A memtable of fingerprints as a sorted run a bucket."""
    own = _sorted(np.concatenate(found)) if found else np.empty(0, FINGERPRINT)
    return _out([(b, age, sub, own[i:j].tobytes()) for b, i, j in runs.slices(own["first"].copy(), bits)], _RUN)


def _all_window_runs(window: int, bits: int):
    def flush(key, docs):
        """Fingerprints of all the chunk's windows."""
        found = [_windows(runs.word_hash_pairs(runs.tokens(t)), window) for t in docs["text"].to_pylist()]
        return _flushed(key[0].as_py(), key[1].as_py(), found, bits)

    return flush


def _window_runs(window: int, bits: int):
    def flush(key, docs, back):
        """Fingerprints of the chunk's windows whose anchor another chunk has too."""
        shared = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in back["run"].to_pylist()] or [np.empty(0, np.uint64)]))
        found = []
        if len(shared):
            for text in docs["text"].to_pylist():
                pair = runs.word_hash_pairs(runs.tokens(text))
                keep = runs.member(_anchors(pair[0], window), shared)
                if keep.any():
                    found.append(_windows(pair, window)[keep])
        return _flushed(key[0].as_py(), key[1].as_py(), found, bits)

    return flush


def _merge_windows(key, table):
    """Merge the bucket's runs: fingerprints that an older chunk (or history) has, back to the younger ones."""
    chunks, place, f = _gathered(table, FINGERPRINT)
    order = np.lexsort((place, f["second"], f["first"]))
    f, place = f[order], place[order]
    new = _changes(f)
    oldest = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
    hit = chunks["age"][place] > chunks["age"][oldest]
    return _dealt(chunks, place[hit], f[hit])


def _compact(key, table):
    """A bucket's sorted runs merged into one, each fingerprint once."""
    f = _sorted(np.frombuffer(b"".join(table["run"].to_pylist()), FINGERPRINT))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "run": pa.array([f.tobytes()], pa.binary())})


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def _result(doc_id: int | None, words: list[bytes], starts: np.ndarray, window: int, with_text: bool) -> tuple:
    """starts: the windows to remove."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(starts) else words)
    return doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None


def _remove(window: int, with_text: bool):
    def chunk(key, docs, back):
        ids, texts = docs["doc_id"].to_pylist(), docs["text"].to_pylist()
        old = [np.frombuffer(b, FINGERPRINT) for b in back["run"].to_pylist()]
        found = [_windows(runs.word_hash_pairs(runs.tokens(t)), window) for t in texts]
        lengths = [len(f) for f in found]
        every = np.concatenate([*found, *old])
        # What older chunks have counts as older than any document here.
        doc = np.concatenate([np.repeat(np.array(ids, np.int64), lengths), np.full(len(every) - sum(lengths), OLDEST)])
        order = np.lexsort((doc, every["second"], every["first"]))
        d, new = doc[order], _changes(every[order])
        later = np.zeros(len(doc), bool)
        if len(doc):
            later[order] = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
        ends = np.cumsum([0, *lengths])
        return _out([_result(i, runs.tokens(t), np.flatnonzero(later[a:b]), window, with_text) for i, t, a, b in zip(ids, texts, ends[:-1], ends[1:], strict=True)], _RESULT)

    return chunk


def _whole(window: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.empty(0, np.int64)
            yield from _out([_result(None, runs.tokens(t), none, window, with_text) for t in batch.column(0).to_pylist()], _RESULT).to_batches()

    return rows


class WindowIndex:
    """Sorted immutable runs of the window fingerprints of earlier batches, in levels of a folder.

    ``add`` flushes a batch's windows as a run by bucket; FAN_IN runs of a level
    are compacted into one.  ``dedup(batch, history=index.history(spark))``
    merge-joins a batch's runs with them.  ``bits`` buckets (as a power of two)
    and ``window`` are the same for all batches.
    """

    FAN_IN = 4

    def __init__(self, folder: str, window: int = WINDOW, bits: int = runs.LEAST_BITS):
        self.window, self.bits = window, bits
        self.levels = Levels(folder, RUN, self.compact, self.FAN_IN)

    def compact(self, *parts: DataFrame) -> DataFrame:
        merged = parts[0].select("bucket", "run")
        for p in parts[1:]:
            merged = merged.unionByName(p.select("bucket", "run"))
        return merged.groupBy("bucket").applyInArrow(_compact, RUN)

    def history(self, spark: SparkSession) -> DataFrame | None:
        return self.levels.history(spark)

    def add(self, docs: DataFrame) -> None:
        """Null texts and doc_ids and texts shorter than a window add nothing; an empty table adds an empty run."""
        known, _ = _chunked(docs)
        self.levels.add(self.compact(known.groupBy(*CHUNK).applyInArrow(_all_window_runs(self.window, self.bits), CHUNK_RUN)))


def _chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(age, sub, doc_id, text) of the rows with a doc_id, and the bytes of all texts.

    Chunks are ranges of doc_ids.  A range of too many rows or bytes is cut into
    its doc_ids, and a repeated one of these by rows; a chunk of one doc_id may be
    cut anywhere, since rows of one doc_id don't remove each other's words.
    """
    known = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).where("doc_id IS NOT NULL")
    bits = runs.chunk_bits(known)
    ranged = known.withColumn("_range", F.shiftright("doc_id", bits))
    ranges = cut(ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_bytes")))
    total = ranges.agg(F.sum("_bytes"), F.sum("_n")).first()
    crowded = ranges.where((F.col("_n") > 8 * runs.PER_CHUNK) | (F.col("_bytes") > CHUNK_BYTES))
    parts = (F.col("_n") / runs.PER_CHUNK + F.col("_bytes") / CHUNK_BYTES * 8).cast("int") + 1
    age = F.call_function("shiftleft", F.col("_range"), F.lit(bits))
    if crowded.limit(1).count():
        hot = F.col("_n") * 1024 > F.lit(total[1])
        ranged = looked_up(ranged, crowded.select("_range", parts.alias("_parts"), hot.alias("_hot")), "_range", F.monotonically_increasing_id())
        own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")).cast("int")
        sub = F.coalesce(own, F.lit(0))
        # The rows are read three times, and must come to the same chunks each time.
        chunked = cut(ranged.select(F.when(F.col("_parts").isNull(), age).otherwise(F.col("doc_id")).alias("age"), sub.alias("sub"), "doc_id", "text"))
    else:
        chunked = ranged.select(age.alias("age"), F.lit(0).alias("sub"), "doc_id", "text")
    return chunked, total[0] or 0


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False, history: DataFrame | None = None, bits: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id.  Chunks of doc_ids are the batches of the
    log.  First sorted runs of anchors (the smallest gram of each window, about
    a fifth of the windows) are merged: a window can only repeat in another
    chunk if its anchor does.  Fingerprints of the windows left, two independent
    64-bit hashes of their words, are flushed as sorted runs by bucket and
    merge-joined; younger chunks get their hits back, verify both hashes, and
    remove them together with repeats among themselves.  A hash travels once a
    chunk however many documents share it.

    history: runs of a ``WindowIndex`` (whose window and bits are passed on);
    words of a window that history holds go as well, and all windows of the
    batch are merge-joined.  Batches added one after the other, in the order of
    doc_ids, give the result of one pass.

    Null or short text: nothing to remove.  Null doc_id: neither removes nor
    loses words.  Rows with one doc_id: don't remove each other's words.  Empty
    table: empty result.  docs' other columns are not read.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    known, total = _chunked(docs)
    by_chunk = known.groupBy(*CHUNK)
    if history is None:
        bits = runs.bucket_bits(total, 1 / 30)
        anchors = by_chunk.applyInArrow(_anchor_runs(window, bits), CHUNK_RUN)
        shared = anchors.groupBy("bucket").applyInArrow(_merge_anchors, BACK)
        windows = by_chunk.cogroup(shared.groupBy(*CHUNK)).applyInArrow(_window_runs(window, bits), CHUNK_RUN)
    else:
        bits = runs.LEAST_BITS if bits is None else bits
        old = history.select("bucket", F.lit(OLDEST).cast("bigint").alias("age"), F.lit(0).alias("sub"), "run")
        windows = by_chunk.applyInArrow(_all_window_runs(window, bits), CHUNK_RUN).unionByName(old)
    hits = windows.groupBy("bucket").applyInArrow(_merge_windows, BACK)
    out = by_chunk.cogroup(hits.groupBy(*CHUNK)).applyInArrow(_remove(window, with_text), RESULT)
    nameless = docs.where(docs["doc_id"].isNull()).select(docs["text"].cast("string").alias("text")).mapInArrow(_whole(window, with_text), RESULT)
    with small_batches(docs.sparkSession):
        out = cut(out.unionByName(nameless))
    return out if with_text else out.drop("kept_text")


#: The same in DuckDB.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM d, unnest(range(1, len(w) - 11)) AS r(i)
), late AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id
), gone AS (SELECT DISTINCT rid, i + k AS p FROM late, range(13) AS r(k)),
kept AS (
  SELECT rid, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (rid, p) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
