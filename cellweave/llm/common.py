"""Pieces shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space is \x20 and \x09-\x0D, as bytes.split() has it.
SPACE = r"[\x20\x09-\x0D]"
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_A_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` of the session names.

    Where it is unset, a temporary folder serves a local master, as in tests;
    on a cluster executors would each write to their own disk, so it is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster names."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``cut``, after which the driver collects its garbage.

    The heap shrinks to a few times what is in use, and shuffle files and
    checkpoints of earlier steps go.  Without it a plan of many steps on many
    partitions lets the heap grow to its limit and keeps it there, beside what
    classes, compiled code and threads take.
    """
    out = cut(df)
    df.sparkSession._jvm.System.gc()
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: int = 32 << 20):
    """Arrow batches of few rows and bytes, so that long texts fit a Python worker; the session's own settings come back after.

    The settings hold for what runs inside, so plans over texts are cut there.
    """
    own = {ROWS_A_BATCH: str(rows), BYTES_A_BATCH: str(size)}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_blocks(n: Column, first: Column, kind: str, step) -> Column:
    """The outputs of step(state, i) -> struct(state, out) for i from 0 to n - 1, as one array of ``kind``.

    An array can't grow in place, so outputs are gathered in about sqrt(n)
    blocks and flattened: n**1.5 pointer copies, not n**2.
    """

    def block(acc: Column, k: Column, wide: Column) -> Column:
        start = F.struct(acc["state"].alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("outs"))
        grow = lambda a, i: let(step(a["state"], i), lambda x: F.struct(x["state"].alias("state"), F.concat(a["outs"], F.array(x["out"])).alias("outs")))
        inner = F.aggregate(F.sequence(k * wide, F.least(n, (k + 1) * wide) - 1), start, grow)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["outs"], F.array(x["outs"])).alias("outs")))

    def every(wide: Column) -> Column:
        start = F.struct(first.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("outs"))
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int"))
        return F.aggregate(blocks, start, lambda acc, k: block(acc, k, wide), lambda a: F.flatten(a["outs"]))

    return F.when(n > 0, let(F.ceil(F.sqrt(n)).cast("int"), every)).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between white space, unchanged."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path; ``removed`` deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def looked_up(rows: DataFrame, found: DataFrame, key: str, spread: Column) -> DataFrame:
    """rows with found's columns, by a left join on the column ``key``; found has one row a key, and ``_hot``.

    Fewer than 1024 keys may be hot; they are broadcast, and their rows get a
    salt (``spread``, a function of the row) in the join of the others, so a key
    with a third of all rows meets in no task.
    """
    names = [c for c in found.columns if c not in (key, "_hot")]
    part = lambda hot, name: found.where(F.col("_hot") == F.lit(hot)).select(F.col(key).alias(f"_k{name}"), F.struct(*names).alias(name))
    marked = rows.join(F.broadcast(part(True, "_h")), F.col(key) == F.col("_k_h"), "left")
    marked = marked.withColumn("_salt", F.when(F.col("_k_h").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 30)) + 1))
    cold = part(False, "_c").withColumn("_salt_c", F.lit(0).cast("bigint"))
    met = marked.join(cold, (F.col(key) == F.col("_k_c")) & (F.col("_salt") == F.col("_salt_c")), "left")
    return met.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col("_h")[n], F.col("_c")[n]).alias(n) for n in names])


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place from 0 in a total order, by one range sort: rows before in the partition plus rows of the partitions before."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_in": inside}))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row a partition, so the window is small and the rows can be broadcast.
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return numbered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


class Levels:
    """Immutable runs as tables of a shared folder, in levels.

    ``add`` stores a run in level 0; ``fan_in`` runs of a level are compacted
    into one of the next, and only then deleted.  A run counts from the moment
    its table is complete, so a lost job leaves the index as it was.
    """

    def __init__(self, folder: str, schema: str, compact, fan_in: int = 4):
        self.folder, self.schema, self.compact, self.fan_in = folder, schema, compact, fan_in

    def stored(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(level, path) of the complete runs."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        whole = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((int(p.getName().split("-")[1]), p.toString()) for p in whole)

    def history(self, spark: SparkSession) -> DataFrame | None:
        """The stored runs, each row with its run's name; None if there are none."""
        out = None
        for _, p in self.stored(spark):
            part = spark.read.schema(self.schema).parquet(p).withColumn("run_name", F.lit(p))
            out = part if out is None else out.unionByName(part)
        return out

    def add(self, run: DataFrame, level: int = 0) -> None:
        spark = run.sparkSession
        run.sortWithinPartitions("bucket").write.parquet(f"{self.folder}/level-{level}-{uuid.uuid4().hex}")
        full = [p for n, p in self.stored(spark) if n == level]
        if len(full) >= self.fan_in:
            self.add(self.compact(*[spark.read.schema(self.schema).parquet(p) for p in full]), level + 1)
            for p in full:
                removed(spark, p)
