"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, looked_up, ranked, removed, text_of, written

CYCLE = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2
#: Documents of one flight. A block leaves two undecided documents at most, so each round divides their number by half of this.
BLOCK, LEAST_BLOCK = 1024, 8
EPS = 1e-9
STATE = ["doc_id", "source", "size", "_rid", "source_size", "target", "_whole", "_p", "_order", "_rows"]


def words_in(docs: DataFrame) -> Column:
    return F.regexp_count(text_of(docs), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, source_rows, target): one row a source, sources in code point order and null last.

    ``share`` of all sizes is dealt out by weight; sources above ``most`` times
    their size stop there and the excess goes to the others by weight, until
    none is above.  So the target is min(most * source_size, level * weight), and
    each turn finds the level that the sources full so far leave.  Turns end
    when no more source fills up, usually after two or three.

    Null source: the last of the sources.  Null sizes count as 0; sizes of 0
    everywhere give targets of 0.  Empty table: empty result.  Other columns are
    not read.
    """
    if not cycle or min(cycle) <= 0 or share < 0 or most < 0:
        raise ValueError("weights must be above 0, share and most not below")
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count("*").alias("source_rows"))
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("_rank") % len(cycle) + 1).cast("int"))
    weighed = cut(ranked(totals, [F.col("source").asc_nulls_last()], "_rank").withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, F.lit(False)
    number = -1
    while True:
        found = weighed.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if found[0] == number or not found[2]:
            break
        number, level = found[0], (total - (found[1] or 0.0)) / found[2]
        full = full | (F.col("_cap") < F.col("_w") * F.lit(level))
    return weighed.select("source", "source_size", "source_rows", F.when(full, F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.lit(level))).alias("target"))


def flight(p: list[float], sizes: list[float], draw: random.Random) -> None:
    """Move the probabilities p in place until two at most are neither 0 nor 1, keeping sum(p) and sum(p * size).

    Three undecided documents have one direction along which both sums stay;
    the step ends where a probability meets 0 or 1, and the two ends are chosen
    so that the expectation of p stays.  When none of three is left, or their
    number is below three, directions that keep only sum(p * size) aren't used:
    what is left is the landing problem.
    """
    active: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[k]) / v if v > 0 else p[k] / -v) for k, v in zip(active, u, strict=True) if v)
        down = min((p[k] / v if v > 0 else (1 - p[k]) / -v) for k, v in zip(active, u, strict=True) if v)
        step = up if draw.random() * (up + down) < down else -down
        for k, v in zip(active, u, strict=True):
            p[k] += step * v
            if not EPS < p[k] < 1 - EPS:
                p[k] = float(round(p[k]))
        active = [k for k in active if EPS < p[k] < 1 - EPS]


def land(p: list[float], sizes: list[float]) -> None:
    """Decide the few documents left of a whole source: the choice that changes the tokens least, then the documents."""
    left = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    if left:
        off = lambda choice: (abs(sum((x - p[i]) * sizes[i] for x, i in zip(choice, left, strict=True))), abs(sum(x - p[i] for x, i in zip(choice, left, strict=True))))
        for x, i in zip(min(itertools.product((0.0, 1.0), repeat=len(left)), key=off), left, strict=True):
            p[i] = x


def _fly(seed: int, last: bool):
    def block(key, table):
        order, rid, ids = (table[c].to_pylist() for c in ("_order", "_rid", "doc_id"))
        start, size = table["_p"].to_pylist(), table["size"].to_pylist()
        # The place in the scan orders only rows alike in doc_id and size, so another layout draws the same.
        rows = sorted(range(len(rid)), key=lambda i: (order[i], ids[i] is None, ids[i] or 0, size[i], rid[i]))
        p, sizes = [start[i] for i in rows], [float(size[i]) for i in rows]
        flight(p, sizes, random.Random(f"{seed}/{key[0].as_py()}/{key[1].as_py()}"))
        if last:
            land(p, sizes)
        for i, x in zip(rows, p, strict=True):
            start[i] = x
        return table.select(STATE).set_column(STATE.index("_p"), "_p", pa.array(start, pa.float64()))

    return block


def mix(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: int = MOST_COPIES, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source is expected target/source_size times; the whole
    part is certain and the fraction is the inclusion probability of the cube
    method, balanced on tokens and documents.  Blocks of a source are flown in
    parallel, then what they leave, until a source fits one block and lands.

    Null text: size 0.  Null source: a source of its own, the last.  A source of
    size 0: never taken.  Null or repeated doc_ids: rows are decided apart.
    Empty table: empty result.  docs' other columns are not read.  Reruns agree
    for any layout of the input, but for null doc_ids; seed changes the draw.
    """
    return _mixed(docs, F.monotonically_increasing_id(), cycle, share, most, seed, block)


def _mixed(docs: DataFrame, rid: Column, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: int = MOST_COPIES, seed: int = 7, block: int = BLOCK) -> DataFrame:
    if block < LEAST_BLOCK:
        raise ValueError(f"block must be at least {LEAST_BLOCK}")
    sizes = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), words_in(docs).alias("size"), rid.alias("_rid"))
    sizes = cut(sizes)
    aims = cut(targets(sizes, cycle, share, most))
    # A source's row reaches all its documents. Sources are few against documents, yet unbounded: broadcast only up to a checked count.
    named = lambda df: df.withColumn("_name", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))
    aimed, left = named(aims).drop("source"), named(sizes)
    if aims.limit(100_001).count() <= 100_000:
        met = left.join(F.broadcast(aimed), "_name")
    else:
        hot = F.col("source_rows") * 1024 > F.lit(sizes.count())
        met = looked_up(left, cut(aimed.withColumn("_hot", hot)), "_name", F.col("_rid"))
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(mean + F.lit(EPS))
    order = F.xxhash64(F.lit(seed), "doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("_rid")))
    state = met.withColumns({"_whole": whole.cast("int"), "_p": F.greatest(mean - whole, F.lit(0.0)), "_order": order, "_rows": F.col("source_rows")}).select(*STATE)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)
    done: DataFrame | None = None
    largest = met.agg(F.max("source_rows")).first()[0] or 0
    turn = 0
    while True:
        last = largest <= block
        blocks = F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(block))).cast("int")
        dealt = state.withColumn("_block", F.pmod(F.xxhash64("_order", F.lit(turn)), blocks).cast("int"))
        flown = dealt.groupBy("source", "_block").applyInArrow(_fly(seed + turn, last), ddl)
        if last:
            break
        flown = cut(flown)
        decided = (F.col("_p") < EPS) | (F.col("_p") > 1 - EPS)
        done = flown.where(decided) if done is None else done.unionByName(flown.where(decided))
        state = flown.where(~decided)
        largest = -(-largest // block) * 2
        state = state.withColumn("_rows", (F.ceil(F.col("_rows") / F.lit(block)) * 2).cast("bigint"))
        turn += 1
    out = flown if done is None else done.unionByName(flown)
    copies = F.col("_whole") + F.round("_p").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), "_rid")


def repeat(docs: DataFrame, **options) -> DataFrame:
    """docs' rows with all their columns, each as often as ``mix`` takes it.

    The rows are written and numbered once, so rows alike in all that ``mix``
    reads are told apart by their number.  Null text or source, null or repeated
    doc_ids: as in ``mix``.  Empty table: empty result.
    """
    spark = docs.sparkSession
    packed = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("_row"))
    stored, path = written(packed)
    try:
        drawn = _mixed(stored.select(*[F.col("_row")[c].alias(c) for c in ("doc_id", "source", "text")], "_rid"), F.col("_rid"), **options)
        met = stored.join(drawn.where("copies > 0").select("_rid", "copies"), "_rid")
        times = met.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        return cut(times.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
    finally:
        removed(spark, path)
