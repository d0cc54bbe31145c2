"""Grid partitioners that grow, walk or paint, and the fill of cells that these leave."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import bits, uniform
from ..sources.grids import cells
from .agents import _even, fill_to_capacity

SEED = 42


def fill_nearest(assignment: DataFrame) -> DataFrame:
    """Cells without a cluster take that of the nearest cell with one, in city-block distance, ties to the lowest cluster.

    The distance separates: first along each row to both sides, then along each
    column as a running minimum of the distance less (or plus) the row number.
    So it takes four windows and no rounds; rows and columns are the groups.
    """
    seen = F.when(F.col("cluster_id").isNotNull(), F.struct(F.col("col").alias("c"), F.col("cluster_id").alias("k")))
    before, after = W.partitionBy("row").orderBy("col").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("row").orderBy("col").rowsBetween(0, W.unboundedFollowing)
    line = assignment.withColumns({"_l": F.last(seen, ignorenulls=True).over(before), "_r": F.first(seen, ignorenulls=True).over(after)})
    near = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("col") - F.col(s)["c"]).alias("d"), F.col(s)["k"].alias("k")))
    line = line.withColumn("_g", F.array_min(F.array_compact(F.array(near("_l"), near("_r")))))
    up, down = W.partitionBy("col").orderBy("row").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("col").orderBy("row").rowsBetween(0, W.unboundedFollowing)
    shifted = lambda by: F.when(F.col("_g").isNotNull(), F.struct((F.col("_g")["d"] + by).alias("d"), F.col("_g")["k"].alias("k")))
    best = line.withColumns({"_a": F.min(shifted(-F.col("row"))).over(up), "_b": F.min(shifted(F.col("row"))).over(down)})
    both = F.array_min(F.array_compact(F.array(
        F.when(F.col("_a").isNotNull(), F.struct((F.col("_a")["d"] + F.col("row")).alias("d"), F.col("_a")["k"].alias("k"))),
        F.when(F.col("_b").isNotNull(), F.struct((F.col("_b")["d"] - F.col("row")).alias("d"), F.col("_b")["k"].alias("k"))),
    )))
    return best.withColumn("cluster_id", F.coalesce("cluster_id", both["k"])).select(*assignment.columns)


def voronoi_seeds(rows: int, cols: int, k: int, seed: int = SEED) -> list[tuple[int, int]]:
    """A seed a cluster: row k/sqrt(k) and column k mod sqrt(k) in units of the spacing, jittered; a taken place moves to the next free cell."""
    space, side = math.sqrt(rows * cols / k), math.sqrt(k)
    out: list[tuple[int, int]] = []
    for c in range(k):
        r = min(max(int(c / side * space + uniform(seed, c, 1) * space), 0), rows - 1)
        q = min(max(int(math.fmod(c, side) * space + uniform(seed, c, 2) * space), 0), cols - 1)
        at = r * cols + q
        while (at // cols, at % cols) in out:
            at = (at + 1) % (rows * cols)
        out.append((at // cols, at % cols))
    return out


def voronoi(spark: SparkSession, rows: int, cols: int, k: int, seed: int = SEED) -> DataFrame:
    """Balanced growth: cells go to the nearest seed with room for rows * cols / k cells; the few left over to the nearest seed."""
    k = min(k, rows * cols)
    return fill_to_capacity(cells(spark, rows, cols), voronoi_seeds(rows, cols, k, seed), [rows * cols // k] * k)


def _maze_depths(rows: int, cols: int, seed: int) -> list[int]:
    """Depths of a randomised depth-first walk from the corner; the corner's 0 counts as unvisited, so it is entered again."""
    depth, stack, draw = [0] * (rows * cols), [0], 0
    while stack:
        at = stack[-1]
        r, c = divmod(at, cols)
        free = [n for n, ok in ((at - cols, r > 0), (at + cols, r < rows - 1), (at - 1, c > 0), (at + 1, c < cols - 1)) if ok and depth[n] == 0]
        if not free:
            stack.pop()
            continue
        to = free[bits(seed, draw) % len(free)]
        draw += 1
        depth[to] = depth[at] + 1
        stack.append(to)
    return depth


def maze(spark: SparkSession, rows: int, cols: int, k: int, seed: int = SEED) -> DataFrame:
    """Depth of a maze walk, scaled to k. The walk is sequential, so one task makes it."""

    def walk(pdf):
        import pandas as pd

        depth = _maze_depths(rows, cols, seed)
        return pd.DataFrame({"cell_id": range(rows * cols), "cluster_id": [d * k // (max(depth) + 1) for d in depth]})

    made = spark.range(1).groupBy("id").applyInPandas(walk, "cell_id bigint, cluster_id bigint")
    return cells(spark, rows, cols).join(made, "cell_id").select("row", "col", "cell_id", "cluster_id")


def l_system_path(rows: int, cols: int, k: int, rounds: int = 3) -> dict[tuple[int, int], int]:
    """Cells on the turtle's way with their clusters; later steps cover earlier ones. Steps off the grid aren't made but count."""
    text = "F"
    for _ in range(rounds):
        text = text.replace("F", "F+F-F+F")
    part, step, turn = max(1, len(text) // k), 0, 0
    x, y, out = 0, rows // 2, {}
    for c in text:
        if c == "F":
            dx, dy = ((1, 0), (0, 1), (-1, 0), (0, -1))[turn]
            if 0 <= x + dx < cols and 0 <= y + dy < rows:
                out[y, x] = min(step // part, k - 1)
                x, y = x + dx, y + dy
            step += 1
        else:
            turn = (turn + (1 if c == "+" else 3)) % 4
    return out


def _painted(spark: SparkSession, rows: int, cols: int, paint: list[tuple[int, int]]) -> DataFrame:
    """cells with the cluster of those painted (cell_id, cluster_id)."""
    made = spark.createDataFrame(paint or [(-1, 0)], "cell_id bigint, cluster_id bigint")
    return cells(spark, rows, cols).join(made, "cell_id", "left").select("row", "col", "cell_id", "cluster_id")


def l_system(spark: SparkSession, rows: int, cols: int, k: int) -> DataFrame:
    return fill_nearest(_painted(spark, rows, cols, [(r * cols + c, n) for (r, c), n in l_system_path(rows, cols, k).items()]))


def flow_field(spark: SparkSession, rows: int, cols: int, k: int, seed: int = SEED) -> DataFrame:
    """k particles, each traced in a task of its own through an angle field for its share of cells; the later covers the earlier."""

    def trace(pdf):
        import pandas as pd

        n = int(pdf["id"][0])
        x, y, seen = uniform(seed, n, 1) * cols, uniform(seed, n, 2) * rows, set()
        for _ in range(rows * cols // k):
            i, j = int(y), int(x)
            if 0 <= x < cols and 0 <= y < rows:
                seen.add(i * cols + j)
            i, j = min(max(i, 0), rows - 1), min(max(j, 0), cols - 1)
            angle = math.sin(i * 0.1) * math.cos(j * 0.1) * math.pi
            x, y = x + math.cos(angle), y + math.sin(angle)
        return pd.DataFrame({"cell_id": sorted(seen), "cluster_id": n})

    made = spark.range(k).groupBy("id").applyInPandas(trace, "cell_id bigint, cluster_id bigint").groupBy("cell_id").agg(F.max("cluster_id").alias("cluster_id"))
    return fill_nearest(cells(spark, rows, cols).join(made, "cell_id", "left").select("row", "col", "cell_id", "cluster_id"))


def h_bars(rows: int, cols: int, k: int) -> list[tuple[int, int, int, int, int]]:
    """(top, left, height, width, cluster) of boxes in the order in which their middle bars are painted."""
    out: list[tuple[int, int, int, int, int]] = []

    def box(top: int, left: int, height: int, width: int, depth: int) -> None:
        if depth >= math.log2(k):
            return
        out.append((top, left, height, width, depth % k))
        down, across = top + height // 2, left + width // 2
        for t, q in ((top, left), (top, across), (down, left), (down, across)):
            box(t, q, height // 2, width // 2, depth + 1)

    box(0, 0, rows, cols, 0)
    return out


def recursive_h(row: Column, col: Column, rows: int, cols: int, k: int) -> Column:
    """The last bar that covers the cell, or null: an array literal of fewer than k * k boxes, no join."""
    boxes = h_bars(rows, cols, k)
    if not boxes:
        return F.lit(None).cast("bigint")
    literal = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("tlhwk", b, strict=True)], F.lit(n).alias("n")) for n, b in enumerate(boxes)])

    def covers(b: Column) -> Column:
        upright = (col == b["l"] + F.call_function("div", b["w"], F.lit(2))) & (row >= b["t"]) & (row < b["t"] + b["h"])
        flat = (row == b["t"] + F.call_function("div", b["h"], F.lit(2))) & (col >= b["l"]) & (col < b["l"] + b["w"])
        return upright | flat

    return F.array_max(F.transform(F.filter(literal, covers), lambda b: F.struct(b["n"].alias("n"), b["k"].alias("k"))))["k"].cast("bigint")
