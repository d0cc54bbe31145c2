"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous sweeps."""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_batches

CAPACITY = 1024
END = 2
RANK_BITS = 44
SPECIAL = "<|endoftext|>"
#: A text with a longer run of white space goes to the tokenizer file's own tokenizer; tiktoken fails at about a million.
MOST_BLANKS = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, in_part bigint"


@functools.cache
def encoder(vocabulary: str | None = None):
    """text -> ids, equal to the vocabulary file's own tokenizer with add_special_tokens=False.

    For the bundled file the byte-pair merges run in tiktoken over the same
    vocabulary as ranks, which is several times faster.  A text that holds a
    special token's string, or a run of white space so long that tiktoken's
    pattern could exhaust its stack, goes to the tokenizer of the file itself,
    as do all texts for another vocabulary.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    bundled = public_tokenizers.path("byte_bpe_50k.json")
    file = Tokenizer.from_file(vocabulary or bundled)
    exact = lambda text: file.encode(text, add_special_tokens=False).ids
    if vocabulary and vocabulary != bundled:
        return exact
    with open(bundled.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    blank = re.compile(rf"(?<!\s)\s{{{MOST_BLANKS}}}")

    def encode(text: str) -> list[int]:
        plain = SPECIAL not in text and (len(text) < MOST_BLANKS or not blank.search(text))
        return fast.encode_ordinary(text) if plain else exact(text)

    return encode


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: whole capacities, but for the first piece."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _cut_up(capacity: int, vocabulary: str | None, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[tuple] = []
            kept: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    raw = ids[start : start + length].tobytes()
                    out.append((doc_id, k, start, length, zlib.crc32(raw), part, seen.get(length, 0)))
                    seen[length] = seen.get(length, 0) + 1
                    if with_ids:
                        kept.append(raw)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch(columns + [pa.array(kept, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return pieces


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go: (length, first rank, pieces, first sequence, offset).

    One sweep a length, from the longest.  Pieces of a length are told apart
    only by their ranks, gaps of a size only by their sequences, so a sweep
    matches whole ranges of ranks with whole ranges of sequences: the smallest
    gap that fits (the successor of the length) takes one piece in each of its
    sequences, in the order of rank, and becomes a smaller gap; the rest of the
    pieces open sequences.  The work is bounded by capacity squared and doesn't
    depend on the number of documents.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> ranges of sequences (first, number)
    order: list[int] = []  # the sizes, sorted
    placed, sequences = [], 0

    def leave(gap: int, first: int, number: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                # No gap fits: as many new sequences as the rest fills with pieces of this length, one for a rest that fills none.
                number = max(1, left // (capacity // length))
                first, sequences = sequences, sequences + number
                leave(capacity, first, number)
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            taken = min(number, left)
            if taken < number:
                gaps[gap].append((first + taken, number - taken))
            elif not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            placed.append((length, rank, taken, first, capacity - gap))
            leave(gap - length, first, taken)
            rank, left = rank + taken, left - taken
    return placed


def _place(planned):
    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, firsts, offsets = planned.value
        for batch in batches:
            names = batch.schema.names
            length, rank = (np.asarray(batch.column(names.index(c))) for c in ("length", "_rank"))
            # The last range that starts at or before (length, rank); ranges of a length begin at rank 0.
            at = np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1
            kept = [n for n in names if n != "_rank"]
            columns = [batch.column(names.index(n)) for n in kept]
            yield pa.record_batch([*columns, pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], names=[*kept, "sequence_id", "offset"])

    return seats


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids as little-endian bytes).

    A document is its token ids and then id 2.  One longer than ``capacity`` is
    cut into pieces of ``capacity``, the first of which may be shorter.  Rounds
    go over the lengths in descending order (see ``plan``) on the counts of
    pieces by length, of which there are ``capacity`` at most, so they run on
    the driver; ranks within a length and the seats of all pieces are found in
    parallel: a piece's rank is its number among its task's pieces of this
    length plus those of earlier tasks, so no length meets in one task.

    Null or empty text: the end id alone.  Null or repeated doc_ids: packed row
    by row.  Empty table: empty result.  docs' other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    text = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        pieces = cut(text.mapInArrow(_cut_up(capacity, vocabulary, with_ids), PIECES + ", ids binary" * with_ids))
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("_rank", F.col("in_part") + F.col("_start")).drop("part", "in_part", "_start")
    seats = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    planned = docs.sparkSession.sparkContext.broadcast(((seats[:, 0] << RANK_BITS) + seats[:, 1], seats[:, 1], seats[:, 3], seats[:, 4]))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return ranked.select(*columns, "_rank").mapInArrow(_place(planned), f"{ddl}, sequence_id bigint, offset bigint")
