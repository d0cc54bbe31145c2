"""N-gram Jaccard join with rare-first prefixes and length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs
from .common import looked_up, removed, settled, small_batches, written

SHINGLE = 5
#: Documents link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Of a prefix gram: its set's size, and its place in the set's order.
PLACE = ("n", "pos")
FACTOR, SHORT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

_RUN = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("run", pa.binary())])
_BACK = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("run", pa.binary()), ("often", pa.binary())])
BACK = "chunk bigint, bucket int, run binary, often binary"
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.binary()), ("gram", pa.int64()), ("pos", pa.int32()), ("single", pa.int32()), ("grams", pa.binary())])
ROWS = "doc_id bigint, n bigint, cid binary, gram bigint, pos int, single int, grams binary"
#: Sets of a gram's group that meet in one task; larger groups are divided into blocks.
BLOCK = 512


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of fewer words, of the whole sequence."""
    h = runs.word_hashes(runs.tokens(text, lower=True))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return runs.mix(runs.rolling(h, len(h), FACTOR) ^ np.uint64(SHORT * len(h) & 0xFFFFFFFFFFFFFFFF))
    return np.unique(runs.rolling(h, SHINGLE, FACTOR))


def _identity(grams: np.ndarray) -> bytes:
    """128 bits that name a set; texts of one set are one class."""
    return xxhash.xxh3_128_digest(grams.tobytes())


def prefix(n: int) -> int:
    """Of n grams, so many rarest hold one gram of any set that links: n minus the least overlap, plus 1."""
    return n + (-PERCENT * n // 100) + 1


def _keys(grams: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's number; equal keys of different grams only make a gram look less rare."""
    return ((grams >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _gram_runs(bits: int):
    def flush(key, docs):
        """The grams of each set of a chunk, sorted, as one run a bucket; equal sets count once."""
        sets = {g.tobytes(): g for g in map(shingles, docs["text"].to_pylist()) if len(g)}
        own = np.sort(np.concatenate(list(sets.values()) or [np.empty(0, np.uint64)]))
        keys = _keys(own, bits)
        return _table([(b, key[0].as_py(), keys[i:j].tobytes()) for b, i, j in runs.slices(own, bits)], _RUN)

    return flush


def _count(key, table):
    """How often each gram occurs in all runs; grams found twice or more go back to their chunks with log2 of that."""
    chunks, place, keys = runs.gathered(table, np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], place[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[starts, len(keys)])
    often = np.repeat(np.log2(counts).astype(np.uint8), counts)
    again = np.r_[True, (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])]
    chosen = (often > 0) & again
    keys, place, often = keys[chosen], place[chosen], often[chosen]
    bucket = key[0].as_py()
    return _table([(c, bucket, keys[i].tobytes(), often[i].tobytes()) for c, i in runs.dealt(chunks, place)], _BACK)


def _prefixes(bits: int):
    def chunk(key, docs, back):
        """A row for each document; for each set whose prefix holds a gram that others have, its grams and those of the prefix."""
        buckets = np.array(back["bucket"].to_pylist(), np.uint64)
        found = [np.frombuffer(b, np.uint32) for b in back["run"].to_pylist()]
        codes = np.concatenate([(b << np.uint64(32)) | k for b, k in zip(buckets, found, strict=True)] or [np.empty(0, np.uint64)])
        often = np.concatenate([np.frombuffer(b, np.uint8) for b in back["often"].to_pylist()] or [np.empty(0, np.uint8)])
        order = np.argsort(codes)
        codes, often = codes[order], often[order]
        columns: dict[str, list] = {f.name: [] for f in _ROWS}
        entries: list[tuple[np.ndarray, ...]] = []
        seen: set[bytes] = set()

        def row(**values) -> None:
            for name, column in columns.items():
                column.append(values.get(name))

        # In the order of ids, so that of a set's documents in the chunk the smallest stands for it.
        for doc_id, text in sorted(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True), key=lambda x: x[0]):
            g = shingles(text)
            n = len(g)
            if not n:
                row(doc_id=doc_id, n=0)
                continue
            cid = _identity(g)
            row(doc_id=doc_id, n=n, cid=cid)
            if cid in seen:
                continue
            seen.add(cid)
            rank = np.zeros(n, np.uint8)
            if len(codes):
                code = g >> np.uint64(32 - bits)
                at = np.searchsorted(codes, code)
                at[at == len(codes)] = 0
                rank = np.where(codes[at] == code, often[at], 0).astype(np.uint8)
            first = np.lexsort((g, rank))[: prefix(n)]
            pos = np.flatnonzero(rank[first] > 0)
            if len(pos):
                row(doc_id=doc_id, n=n, cid=cid, grams=g.tobytes())
                k = len(pos)
                entries.append((np.full(k, n), np.full(k, np.void(cid)), g[first][pos].view(np.int64), pos.astype(np.int32), np.full(k, int((rank == 0).sum()), np.int32)))
        head = pa.table([pa.array(columns[f.name], f.type) for f in _ROWS], schema=_ROWS)
        if not entries:
            return head
        n, cid, gram, pos, single = (np.concatenate(x) for x in zip(*entries, strict=True))
        none = lambda kind: pa.nulls(len(n), kind)
        rest = pa.table([none(pa.int64()), pa.array(n, pa.int64()), pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(cid), [None, pa.py_buffer(cid.tobytes())]).cast(pa.binary()), pa.array(gram, pa.int64()), pa.array(pos), pa.array(single), none(pa.binary())], schema=_ROWS)
        return pa.concat_tables([head, rest])

    return chunk


def _fits(a: list[Column], b: list[Column]) -> Column:
    """Length filter, and positional filter: what two sets (n, pos) can share at most if this gram is the first they share.

    A pair that links passes at its first shared gram, and so comes out; at
    later grams it need not come out again.
    """
    (n1, pos1), (n2, pos2) = a, b
    length = 100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)
    return length & ((100 + PERCENT) * F.least(n1 - pos1, n2 - pos2) >= PERCENT * (n1 + n2))


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link; the suffix filter first bounds the overlap by the sizes of four parts."""
    need = PERCENT * (len(x) + len(y))
    cuts = x[[len(x) // 4, len(x) // 2, 3 * len(x) // 4]]
    parts = lambda s: np.diff(np.r_[0, np.searchsorted(s, cuts), len(s)])
    if (100 + PERCENT) * int(np.minimum(parts(x), parts(y)).sum()) < need:
        return False
    if len(x) > len(y):
        x, y = y, x
    return (100 + PERCENT) * int(runs.member(x, y).sum()) >= need


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = ([np.frombuffer(b, np.uint64) for b in batch.column(i).to_pylist()] for i in (2, 3))
        ok = pa.array([linked(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _met(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """(a, b, _a, _b): pairs of classes with the value of both."""
    one, two = (sets.select(F.col("cid").alias(c), F.col(value).alias(f"_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    return _met(pairs, sets, "grams").mapInArrow(_verify, "a binary, b binary")


def _signed(grams: np.ndarray) -> bytes:
    """How many grams of a set fall in each of about n/2 to n ranges of hashes, after the log2 of the ranges' number and the width of a count."""
    bits = max(4, len(grams).bit_length() - 1)
    counts = np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = np.uint8 if counts.max() < 256 else np.uint32
    return bytes((bits, kind().itemsize)) + counts.astype(kind).tobytes()


def may_link(x: bytes, y: bytes) -> bool:
    """Whether the ranges' counts leave room for a link: sets share at most the smaller count of each range."""
    counts = []
    for s in (x, y):
        own = np.frombuffer(s[2:], np.uint8 if s[1] == 1 else np.uint32)
        counts.append(own.astype(np.int64).reshape(1 << min(x[0], y[0]), -1).sum(axis=1))
    a, b = counts
    return (100 + PERCENT) * int(np.minimum(a, b).sum()) >= PERCENT * int(a.sum() + b.sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = [_signed(np.frombuffer(b, np.uint64)) for b in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(signs, pa.binary())], names=["cid", "sign"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = pa.array([may_link(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
        yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that the suffix filter lets through, on signatures of an eighth of the sets' bytes or less."""
    signs = settled(sets.mapInArrow(_sign, "cid binary, sign binary"))
    return _met(pairs, signs, "sign").mapInArrow(_possible, "a binary, b binary")


def components(links: DataFrame, classes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(cid, label) of the classes that links (a, b) touch: the least (first, cid) that links lead to, by minimum labels and pointer jumps until none changes.

    ``known`` are labels that some of the links led to; the search goes on from them.
    """
    edges = settled(links.select("a", "b").union(links.select("b", "a")).distinct())
    own = F.struct("first", "cid")
    met = classes.join(edges.select(F.col("a").alias("cid")).distinct(), "cid")
    labels = settled(met.select("cid", own.alias("label")) if known is None else met.join(known, "cid", "left").select("cid", F.coalesce("label", own).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("cid", "b"), "b").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "cid").select("cid", "label", F.least("label", "near").alias("to"))
        jumped = lower.join(labels.select(F.col("cid").alias("_at"), F.col("label").alias("far")), F.col("to.cid") == F.col("_at"))
        moved = settled(jumped.select("cid", F.least("to", "far").alias("label"), (F.least("to", "far") != F.col("label")).alias("_moved")))
        labels = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return labels


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()


def _hub_pairs(entries: DataFrame, number: int) -> DataFrame:
    """Each set of a gram's group with three hubs of the group: those with the fewest grams of their own, the smallest, and any.

    Copies of one text link to a hub each, so a group of m copies makes 3m
    pairs, not m squared.
    """
    some = F.call_function("shiftright", F.xxhash64("cid"), F.lit(32)).bitwiseAND(F.lit(0x7FFFFFFF))
    orders = [F.shiftleft(F.col("single").cast("bigint"), 31) + some, F.shiftleft("n", 31) + some, F.xxhash64("cid", F.lit(1))]
    keyed = entries.withColumns({f"_o{i}": o for i, o in enumerate(orders)})
    columns = [F.min_by(c, f"_o{i}").alias(f"{c}{i}") for i in range(3) for c in ("cid", *PLACE)]
    hubs = keyed.groupBy("gram").agg(F.min("cid").alias("_low"), F.max("cid").alias("_high"), F.count("*").alias("_n"), *columns).where("_low < _high")
    hubs = hubs.select("gram", (F.col("_n") * 1024 > F.lit(number)).alias("_hot"), F.array(*[F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("cid", *PLACE)]) for i in range(3)]).alias("hubs"))
    met = looked_up(entries, settled(hubs), "gram", F.col("cid")).select("cid", *PLACE, F.explode(F.array_distinct("hubs")).alias("h"))
    fits = (F.col("h.cid") != F.col("cid")) & _fits([F.col(c) for c in PLACE], [F.col("h")[c] for c in PLACE])
    return _pairs(met.where(fits).select("cid", F.col("h.cid").alias("other")))


def _open_pairs(entries: DataFrame, labels: DataFrame, tested: DataFrame, number: int) -> DataFrame:
    """What is left to test: pairs of a gram's group in different components that were not tested.

    A group of over BLOCK sets is divided into blocks; each pair of blocks meets
    in a task of its own.
    """
    joined = settled(entries.join(labels, "cid", "left").select("gram", "cid", *PLACE, F.coalesce("label.cid", "cid").alias("label")))
    groups = joined.groupBy("gram").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_n")).where("_low < _high")
    mixed = groups.select("gram", (F.col("_n") / BLOCK).cast("int").alias("_last"), (F.col("_n") * 1024 > F.lit(number)).alias("_hot"))
    left = settled(looked_up(joined, settled(mixed), "gram", F.col("cid")).where("_last IS NOT NULL").distinct())
    own, every = F.pmod(F.xxhash64("cid"), F.col("_last") + 1).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_last")))
    one = left.select("gram", "cid", *PLACE, "label", own.alias("_i"), every.alias("_j"))
    two = left.select("gram", *[F.col(c).alias(f"{c}2") for c in ("cid", *PLACE, "label")], every.alias("_i"), own.alias("_j"))
    apart = (F.col("label") < F.col("label2")) & _fits([F.col(c) for c in PLACE], [F.col(f"{c}2") for c in PLACE])
    pairs = _pairs(one.join(two, ["gram", "_i", "_j"]).where(apart).select("cid", F.col("cid2").alias("other")))
    return pairs.join(tested, ["a", "b"], "left_anti")


def _nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([len(shingles(t)) for t in batch.column(0).to_pylist()], pa.int64())], names=["n_shingles"])


def join(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id; documents link from a Jaccard similarity of 0.75.

    1. Documents of one shingle set are one class, named by 128 bits; only
       classes are joined.
    2. All grams are counted, in packed runs by hash bucket.  A set's prefix is
       its rarest grams, of which any linking set has one; a set whose prefix
       nobody shares has no partner and makes no row.
    3. Sets meet on prefix grams, pass the length and positional filters, and
       are verified once a pair, the suffix filter first.  Each meets hubs of
       its group; then all pairs that hubs left in different components are
       tested, so components are those of all links, without all pairs of a
       group of copies.  Those pairs pass the suffix filter on small signatures
       before any set travels.

    Null or empty text: n_shingles 0, linked with nothing.  Null doc_id: linked
    with nothing, component_id null.  Repeated rows: one class.  Empty table:
    empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    known = text.where("doc_id IS NOT NULL")
    number, text_bytes = runs.size(known)
    bits = min(31, runs.bucket_bits(text_bytes, 1 / 12))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, number // runs.PER_CHUNK)).cast("bigint"))
    by_chunk = known.select(chunk.alias("chunk"), "doc_id", "text").groupBy("chunk")
    grams = by_chunk.applyInArrow(_gram_runs(bits), "bucket int, chunk bigint, run binary")
    counted = grams.groupBy("bucket").applyInArrow(_count, BACK)
    with small_batches(spark):
        rows, path = written(by_chunk.cogroup(counted.groupBy("chunk")).applyInArrow(_prefixes(bits), ROWS))
    try:
        with small_batches(spark):
            out = settled(_components_of(rows))
    finally:
        removed(spark, path)
    none = F.lit(None).cast("bigint")
    nameless = text.where("doc_id IS NULL").select("text").mapInArrow(_nameless, "n_shingles bigint").select(none.alias("doc_id"), "n_shingles", none.alias("component_id"))
    return out.unionByName(nameless)


def _components_of(rows: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) from the rows of ``_prefixes``."""
    named = rows.where("gram IS NULL AND grams IS NULL").select("doc_id", "n", "cid")
    classes = settled(named.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")))
    total = classes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    entries = rows.where("gram IS NOT NULL").select("gram", "cid", "n", F.col("pos").cast("bigint").alias("pos"), "single")
    whole = rows.where("grams IS NOT NULL").select("cid", "doc_id", "grams")
    # A class has its grams once a chunk; those of its first document stay.
    first = classes.select(F.col("cid").alias("_cid"), F.col("first").alias("_first"))
    sets = whole.join(first, (F.col("cid") == F.col("_cid")) & (F.col("doc_id") <= F.col("_first")), "left_semi").select("cid", "grams")
    many = entries.count()
    tested = settled(_hub_pairs(entries, many))
    links = settled(verified(tested, sets))
    labels = components(links, classes)
    rest = settled(_open_pairs(entries, labels, tested, many))
    if not rest.isEmpty():
        more = settled(verified(settled(possible(rest, sets)), sets))
        if not more.isEmpty():
            labels = components(links.unionByName(more), classes, labels)
    # A label begins with the smallest doc_id of its component, so no join on labels is left.
    found = classes.join(labels, "cid", "left").select("cid", F.coalesce("label.first", "first").alias("component_id"), (F.col("_n") * 1024 > F.lit(total)).alias("_hot"))
    out = looked_up(named, settled(found), "cid", F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs' rows without those of a component's later documents: the smallest doc_id stays; null doc_ids and rows without words stay.

    Rows repeated with the doc_id that stays all stay; exact deduplication comes
    before.  Empty table: empty result.
    """
    gone = join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


#: The same in DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c AS component_id
FROM s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = s.doc_id
"""
