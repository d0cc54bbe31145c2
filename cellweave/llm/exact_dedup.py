"""Exact deduplication by a log-structured merge index of text digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Levels, cut, looked_up, lower_ascii, small_batches, text_of

#: An entry of a run: a digest, the best identifier if any row has one, and the number of rows.
ENTRY = np.dtype([("digest", "S32"), ("id", "<i8"), ("named", "u1"), ("size", "<i8")])
ROWS = "doc_id bigint, digest binary"
#: A run: for each bucket of digests its sorted entries, each digest once, and a filter of the digests.
RUN = "bucket int, entries binary, filter binary"
_RUN = pa.schema([("bucket", pa.int32()), ("entries", pa.binary()), ("filter", pa.binary())])
#: Entries that a bucket of a run is meant to hold; bits of filters for each of their digests.
PER_BUCKET = 100_000
FILTER_RATE = 16
#: Runs of a level that are compacted into one of the next.
FAN_IN = 4
#: Bits of the filter of hits, by which a task passes its texts to the byte verification: FILTER_RATE a hit, up to 128 MB. A fuller filter passes more texts and changes no result.
LEAST_FILTER, MOST_FILTER = 16, 30


def _digest(text: str | None) -> bytes:
    """SHA-256 of the text with A-Z in lower case; bytes.lower() changes A-Z only."""
    return hashlib.sha256((text or "").encode().lower()).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"doc_id": batch.column(0), "digest": pa.array(map(_digest, batch.column(1).to_pylist()), pa.binary())})


def _filter_bits(number: int) -> int:
    """log2 of the bits of a run's filter, a power of two of at least FILTER_RATE a digest."""
    return max(6, (max(1, number) * FILTER_RATE - 1).bit_length())


def _places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each digest in a filter of 2**bits, from words that the bucket's number leaves alone."""
    words = np.frombuffer(np.ascontiguousarray(digests).tobytes(), "<u8").reshape(-1, 4)
    return (words[:, 2:] & np.uint64((1 << bits) - 1)).astype(np.int64)


def _filter(digests: np.ndarray) -> bytes:
    bits = _filter_bits(len(digests))
    marks = np.zeros(1 << bits, bool)
    marks[_places(digests, bits).ravel()] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _passes(digests: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """Whether each digest may be in the run of the filter (bytes of a power of two)."""
    at = _places(digests, (len(filter_) * 8).bit_length() - 1)
    return ((filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _compacted(entries: np.ndarray, smallest: bool) -> np.ndarray:
    """Sorted runs merged: of each digest the best identifier and the sum of rows."""
    if not len(entries):
        return entries
    order = np.lexsort((entries["id"] if smallest else ~entries["id"], 1 - entries["named"], entries["digest"]))
    entries = entries[order]
    starts = np.flatnonzero(np.r_[True, entries["digest"][1:] != entries["digest"][:-1]])
    out = entries[starts]
    out["size"] = np.add.reduceat(entries["size"], starts)
    return out


def _slices(entries: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, entries) of sorted entries; buckets divide the range of digests evenly."""
    if len(entries):
        upper = np.frombuffer(np.ascontiguousarray(entries["digest"]).tobytes(), ">u4")[::8].astype(np.int64)
        number = upper * buckets >> 32
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        for a, b in zip(starts, [*starts[1:], len(entries)], strict=True):
            yield int(number[a]), entries[a:b]


def _run_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RUN)], schema=_RUN)


def _flush(memtable_rows: int, buckets: int, smallest: bool):
    def flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fill a memtable with (doc_id, digest); a full one is sorted, its equal digests combined, and flushed by bucket."""
        table: list[np.ndarray] = []
        held = 0

        def flush() -> list[pa.RecordBatch]:
            entries = _compacted(np.concatenate(table), smallest)
            table.clear()
            return _run_table([(b, e.tobytes(), None) for b, e in _slices(entries, buckets)]).to_batches()

        for batch in batches:
            own = np.zeros(batch.num_rows, ENTRY)
            own["digest"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), "S32")
            own["named"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            own["id"] = batch.column(0).fill_null(0).to_numpy()
            own["size"] = 1
            table.append(own)
            held += len(own)
            if held >= memtable_rows:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    return flushed


def _merge(smallest: bool):
    def merge(key, runs):
        """A bucket's sorted slices merged into one, with a filter of its digests."""
        entries = _compacted(np.frombuffer(b"".join(runs["entries"].to_pylist()), ENTRY), smallest)
        return _run_table([(key[0].as_py(), entries.tobytes(), _filter(entries["digest"]))])

    return merge


def _needed(key, old, new):
    """The runs whose filter lets one of the batch's digests through."""
    digests = np.frombuffer(b"".join(new["entries"].to_pylist()), ENTRY)["digest"]
    hit = [run for run, f in zip(old["run"].to_pylist(), old["filter"].to_pylist(), strict=True) if _passes(digests, np.frombuffer(f, np.uint8)).any()]
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(hit), pa.int32()), "run": pa.array(hit, pa.string())})


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of several rows, with the best identifier and the number of rows."""
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            e = np.frombuffer(raw, ENTRY)
            e = e[e["size"] > 1]
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(e), [None, pa.py_buffer(np.ascontiguousarray(e["digest"]).tobytes())])
            ids = pa.array(np.ascontiguousarray(e["id"]), mask=e["named"] == 0)
            yield pa.record_batch({"digest": digests.cast(pa.binary()), "keep_id": ids, "group_size": pa.array(np.ascontiguousarray(e["size"]))})


class MergeIndex:
    """Sorted immutable runs of (digest, best identifier, rows) in levels.

    ``rows`` digests a batch, ``flush`` turns it into a run: memtables are
    sorted and flushed by bucket, and a bucket's slices are merged.  ``compact``
    merges runs, keeping of each digest the smallest identifier (or the largest)
    and the sum of rows.  With a folder, ``add`` stores a run as a table of level
    0 that never changes; FAN_IN runs of a level are compacted into one of the
    next, and only then deleted.  ``history`` is all stored runs; ``matching``
    reads, of those, just the buckets whose filter passes a digest of the batch.
    All batches of an index are cut into the same number of ``buckets``; for
    single batches it comes from the number of rows.
    """

    def __init__(self, keep: str = "min", memtable_rows: int = 50_000, folder: str | None = None, buckets: int = 64):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        if memtable_rows < 1 or buckets < 1:
            raise ValueError("memtable_rows and buckets must be at least 1")
        self.keep, self.memtable_rows, self.folder, self.buckets = keep, memtable_rows, folder, buckets

    def rows(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest) of each row."""
        return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_digests, ROWS)

    def flush(self, rows: DataFrame) -> DataFrame:
        return self.compact(rows.select("doc_id", "digest").mapInArrow(_flush(self.memtable_rows, self.buckets, self.keep == "min"), RUN))

    def compact(self, *runs: DataFrame) -> DataFrame:
        merged = runs[0].select("bucket", "entries")
        for r in runs[1:]:
            merged = merged.unionByName(r.select("bucket", "entries"))
        return merged.groupBy("bucket").applyInArrow(_merge(self.keep == "min"), RUN)

    def matching(self, history: DataFrame, run: DataFrame) -> DataFrame:
        """The buckets of history's runs that may hold a digest of the run; of the others only the filters are read."""
        named = history.withColumnRenamed("run_name", "run") if "run_name" in history.columns else history.withColumn("run", F.lit("history"))
        filters = named.select("bucket", "run", "filter").groupBy("bucket")
        needed = filters.cogroup(run.select("bucket", "entries").groupBy("bucket")).applyInArrow(_needed, "bucket int, run string")
        return named.join(needed.distinct(), ["bucket", "run"], "left_semi").select("bucket", "entries")

    @property
    def levels(self) -> Levels:
        return Levels(self.folder, RUN, self.compact, FAN_IN)

    def _stored(self, spark: SparkSession) -> list[tuple[int, str]]:
        return self.levels.stored(spark)

    def history(self, spark: SparkSession) -> DataFrame | None:
        """The stored runs; None if there are none."""
        return self.levels.history(spark)

    def add(self, run: DataFrame) -> None:
        """Store a run; a level of FAN_IN runs becomes one run of the next."""
        self.levels.add(run)


def _filter_of(hits: DataFrame, bits: int) -> bytes:
    """A filter of the hits' digests, built in parts of 2**18 bits; the driver gets no more than the filter."""

    def build(key, part):
        marks = np.zeros(1 << 18, bool)
        marks[np.asarray(part["place"])] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(np.frombuffer(b"".join(batch.column(0).to_pylist()), "S32"), bits).ravel()
            yield pa.record_batch({"part": pa.array(at >> 18), "place": pa.array((at & (1 << 18) - 1).astype(np.int32))})

    marks = hits.select("digest").mapInArrow(places, "part bigint, place int").distinct().groupBy("part").applyInArrow(build, "part bigint, marks binary")
    out = bytearray(max(1 << 15, 1 << bits - 3))
    for r in marks.toLocalIterator():
        out[r["part"] << 15 : (r["part"] + 1) << 15] = r["marks"]
    return bytes(out[: 1 << bits - 3])


def _candidates(bloom):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(digest, normalised bytes) of the rows that pass the filter of hits."""
        marks = np.frombuffer(bloom.value, np.uint8)
        for batch in batches:
            norms = [(t or "").encode().lower() for t in batch.column(0).to_pylist()]
            digests = [hashlib.sha256(n).digest() for n in norms]
            ok = _passes(np.frombuffer(b"".join(digests), "S32"), marks) if norms else []
            kept = [(d, n) for d, n, k in zip(digests, norms, ok, strict=True) if k]
            yield pa.record_batch({"digest": pa.array([d for d, _ in kept], pa.binary()), "norm": pa.array([n for _, n in kept], pa.binary())})

    return texts


def _verified(docs: DataFrame, hits: DataFrame, number: int, earlier: DataFrame | None) -> DataFrame:
    """(digest, texts): how many different normalised texts each digest of several rows has.

    Texts are compared byte by byte: as grouping keys they are combined in each
    task before they are shuffled, so a text with a third of all rows travels
    once a task.
    """
    bits = min(MOST_FILTER, max(LEAST_FILTER, (number * FILTER_RATE).bit_length()))
    bloom = docs.sparkSession.sparkContext.broadcast(_filter_of(hits, bits))
    texts = docs.select(docs["text"].cast("string").alias("text"))
    if earlier is not None:
        texts = texts.unionByName(earlier.select(earlier["text"].cast("string").alias("text")))
    found = texts.mapInArrow(_candidates(bloom), "digest binary, norm binary")
    return found.groupBy("digest", "norm").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts"))


def dedup(docs: DataFrame, keep: str = "max", memtable_rows: int = 50_000, history: DataFrame | None = None, earlier: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    row with the largest doc_id stays (``keep="min"``: the smallest).  The batch
    becomes a run of a ``MergeIndex``; its hits, digests of several rows, are
    verified byte by byte.  history: runs of earlier batches, whose identifiers
    count as well; earlier: the rows behind them (their ``text``), for the byte
    verification, without which hits against history rest on SHA-256 alone;
    buckets: as many as the index of that history has.

    Null text: as empty.  Null doc_id: kept only where no equal text has an id.
    Rows repeated with one doc_id and one text: one of them is kept.  Empty
    table: empty result.  Other columns are not read.
    """
    index = MergeIndex(keep, memtable_rows, buckets=buckets)
    with small_batches(docs.sparkSession):
        rows = cut(index.rows(docs).withColumn("_rid", F.monotonically_increasing_id()))
    total = rows.count()
    if history is None:
        index.buckets = max(1, -(-total // PER_BUCKET))
    run = index.flush(rows)
    if history is not None:
        run = cut(run)
        run = index.compact(run, index.matching(history, run))
    hits = cut(run.select("entries").mapInArrow(_hits, "digest binary, keep_id bigint, group_size bigint"))
    number = hits.count()
    if number:
        with small_batches(docs.sparkSession):
            if _verified(docs, hits, number, earlier).join(hits, "digest", "left_semi").where("texts > 1").limit(1).count():
                raise ValueError("two different texts have one SHA-256 digest")
    # A group of over 1/1024 of the rows is hot.
    hot = F.col("group_size") * 1024 > F.lit(total)
    found = looked_up(rows, hits.withColumn("_hot", hot), "digest", F.col("_rid"))
    out = found.select("doc_id", "digest", "_rid", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Only rows repeated with the kept doc_id can tie; the first of them stays.
    ties = cut(out.where(same & (F.col("group_size") > 1)).groupBy("digest").agg(F.min("_rid").alias("_first"), F.count("*").alias("_n")).where("_n > 1"))
    kept = same
    if ties.limit(1).count():
        out = looked_up(out, ties.withColumn("_hot", F.col("_n") * 1024 > F.lit(total)), "digest", F.col("_rid"))
        kept = same & (F.col("_first").isNull() | (F.col("_first") == F.col("_rid")))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with docs' columns; rows repeated with one doc_id and one text stay once.

    Null texts, null doc_ids and empty tables: as in ``dedup``.
    """
    decided = cut(dedup(docs, keep).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"))
    stay = decided.where("kept").drop("kept")
    twice = cut(decided.groupBy("_id", "_sha").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    packed = docs.select(
        F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row"),
        docs["doc_id"].cast("bigint").alias("_doc"),
        F.sha2(lower_ascii(text_of(docs)), 256).alias("_d"),
    )
    same = lambda other: F.col("_doc").eqNullSafe(other["_id"]) & (F.col("_d") == other["_sha"])
    if not twice.count():
        met = packed.join(stay, same(stay), "left_semi").select("_row")
    else:
        once = stay.alias("s").join(twice.alias("t"), F.col("s._id").eqNullSafe(F.col("t._id")) & (F.col("s._sha") == F.col("t._sha")), "left_anti")
        repeated = packed.join(twice, same(twice), "left_semi").join(stay, same(stay), "left_semi")
        met = packed.join(once, same(once), "left_semi").select("_row").unionByName(repeated.groupBy("_doc", "_d").agg(F.first("_row").alias("_row")).select("_row"))
    return met.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


#: The same in DuckDB, but for rows repeated with one doc_id.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
