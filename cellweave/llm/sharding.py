"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ranked, text_of

#: Draws of one turn of the loop. A key jumps about ln(n) times for n shards, so one turn is nearly always enough; the rest take more turns.
TURN = 64


def _draw(key: Column, i: Column) -> Column:
    """The i-th 31-bit pseudo-random number of a key."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")


def jump(key: Column, shards: int) -> Column:
    """struct(b, j): b is the shard of ``shards``; j >= shards is where the next jump would land.

    With one more shard a key moves only if j equals ``shards``, and then to the new shard.
    A jump moves on by one shard at least, so ``shards`` draws always do; turns
    after the landing cost nothing.
    """
    n = F.lit(shards).cast("bigint")
    start = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def step(acc: Column, i: Column) -> Column:
        r = F.shiftright(_draw(key, i), 1) + F.lit(1)
        to = F.call_function("div", (acc["j"] + 1) * F.lit(1 << 31).cast("bigint"), r)
        return F.when(acc["j"] >= n, acc).otherwise(F.struct(acc["j"].alias("b"), to.alias("j")))

    def turn(acc: Column, k: Column) -> Column:
        draws = F.sequence(k * TURN + 1, F.least(k * TURN + TURN, F.lit(shards)))
        return F.when(acc["j"] >= n, acc).otherwise(F.aggregate(draws, acc, step))

    return F.aggregate(F.sequence(F.lit(0), F.lit((shards - 1) // TURN)), start, turn)


def shard(docs: DataFrame, shards: int = 40, slot_buckets: int = 256) -> DataFrame:
    """Law ``key``: the doc_id and the number of shards decide.

    No ring table: a key's shard comes from its own pseudo-random jumps, and one
    more shard takes rows only into itself.  Slots number a shard's rows from 0
    without gaps, in the order of ``slot_buckets`` hash classes of the key, then
    doc_id (null last), CRC and size.  They come from one range sort of narrow
    rows with offsets, so no shard, class or repeated doc_id meets in one task.

    Null doc_id: one key of its own, so one shard.  Null text: size 16, CRC 0.
    Repeated rows: the same shard, different slots.  Empty table: empty result.
    Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = text_of(docs)
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    keyed = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump(key, shards).alias("_at"),
        (F.conv(F.substring(F.md5(key), 9, 4), 16, 10).cast("int") % slot_buckets).alias("_bucket"),
        # Tells equal rows apart, so that the ranges of the sort divide them as well.
        F.xxhash64(F.monotonically_increasing_id()).alias("_salt"),
    )
    keyed = cut(
        keyed.select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("_at.b").cast("int").alias("shard"),
            F.when(F.col("_at.j") == shards, shards).otherwise(F.col("_at.b")).cast("int").alias("grown_shard"),
            "_bucket",
            "_salt",
        )
    )
    # One row a shard.
    counts = keyed.groupBy("shard").agg(F.count("*").alias("_n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    order = [F.col("shard").asc(), F.col("_bucket").asc(), F.col("doc_id").asc_nulls_last(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("_salt").asc()]
    placed = ranked(keyed, order, "_rank").join(F.broadcast(first), "shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_rank") - F.col("_first")).alias("slot"), "grown_shard")


#: The same in DuckDB.  CRC-32 goes byte by byte with the table of the reflected polynomial 0xEDB88320.
ORACLE_SQL = """
WITH RECURSIVE lookup AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) r(i))
), base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS k,
         octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::BIGINT])), 4294967295) AS text_crc32
  FROM documents, lookup
), jumps AS (
  SELECT rid, k, 1 AS i, -1::BIGINT AS b, 0::BIGINT AS j FROM base
  UNION ALL
  SELECT rid, k, i + 1, j,
         ((j + 1) * 2147483648) // (('0x' || substr(md5(k || ':' || i), 1, 8))::BIGINT // 2 + 1)
  FROM jumps WHERE j < 40
), landed AS (SELECT rid, b, j FROM jumps WHERE j >= 40)
SELECT doc_id, size, text_crc32, 'key' AS law, b::INT AS shard,
       row_number() OVER (PARTITION BY b
         ORDER BY ('0x' || substr(md5(k), 9, 4))::BIGINT % 256, doc_id NULLS LAST, text_crc32, size) - 1 AS slot,
       (CASE WHEN j = 40 THEN 40 ELSE b END)::INT AS grown_shard
FROM base JOIN landed USING (rid)
"""
