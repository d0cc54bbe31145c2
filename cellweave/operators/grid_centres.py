"""Grid partitioners by the nearest of k centres, and Lloyd's iteration."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import bits, uniform


def nearest(score: Callable[[Column], Column], centres: Sequence[tuple], names: Sequence[str]) -> Column:
    """The number of the centre with the least score, ties to the lowest.

    Centres are an array literal beside each row: no join, no shuffle and no
    row for each pair of a cell and a centre.
    """
    literal = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c, strict=True)], F.lit(k).alias("k")) for k, c in enumerate(centres)])
    return F.array_min(F.transform(literal, lambda c: F.struct(score(c).alias("d"), c["k"].alias("k"))))["k"].cast("bigint")


def weighted_centres(rows: int, cols: int, k: int, seed: int = 42) -> list[tuple[int, int, float]]:
    return [(int(uniform(seed, c, 1) * rows), int(uniform(seed, c, 2) * cols), 0.5 + uniform(seed, c, 3)) for c in range(k)]


def galaxy_centres(rows: int, cols: int, k: int, seed: int = 42) -> list[tuple[int, int, float, float]]:
    return [(int(uniform(seed, c, 1) * rows), int(uniform(seed, c, 2) * cols), uniform(seed, c, 3) * math.pi * 2, 0.1 + uniform(seed, c, 4) * 0.4) for c in range(k)]


def lattice_seeds(rows: int, cols: int, k: int) -> list[tuple[int, int]]:
    """Seeds amid the squares of a lattice of ceil(sqrt(k)) a side, row by row."""
    side = math.ceil(math.sqrt(k))
    down, across = max(1, rows // side), max(1, cols // side)
    return [(r, c) for r in range(down // 2, rows, down) for c in range(across // 2, cols, across)][:k]


def euclid(row: Column, col: Column) -> Callable[[Column], Column]:
    return lambda c: (row - c["r"]) * (row - c["r"]) + (col - c["c"]) * (col - c["c"])


def phyllotaxis(seeds: list[tuple[int, int]], row: Column, col: Column) -> Column:
    return nearest(euclid(row, col), seeds, "rc")


def voronoi_weighted(centres: list[tuple[int, int, float]], row: Column, col: Column) -> Column:
    """The least distance over the centre's weight."""
    return nearest(lambda c: F.sqrt(euclid(row, col)(c).cast("double")) / c["w"], centres, "rcw")


def galaxy(centres: list[tuple[int, int, float, float]], row: Column, col: Column) -> Column:
    """The least distance less a spiral arm: tightness times the turned angle times the root of the distance."""

    def score(c: Column) -> Column:
        d = F.sqrt(euclid(row, col)(c).cast("double"))
        return d - c["t"] * (F.atan2(row - c["r"], col - c["c"]) - c["a"]) * F.sqrt(d)

    return nearest(score, centres, "rcat")


def minimal_border(seeds: list[tuple[int, int]], row: Column, col: Column) -> Column:
    """Regions that grow level by level from lattice seeds over 4-neighbours, ties to the lowest cluster.

    On a grid without obstacles the level at which a seed reaches a cell is
    their city-block distance, so the growth has a closed form.
    """
    return nearest(lambda c: F.abs(row - c["r"]) + F.abs(col - c["c"]), seeds, "rc")


def start_cells(total: int, k: int, seed: int = 42) -> list[int]:
    """k different cell numbers by replayable draws."""
    out: list[int] = []
    draw = 0
    while len(out) < min(k, total):
        cell = bits(seed, draw) % total
        if cell not in out:
            out.append(cell)
        draw += 1
    return out


def lloyd(points: DataFrame, axes: Sequence[str], centres: list[tuple], passes: int = 100, truncate: bool = False) -> tuple[DataFrame, list[tuple], int]:
    """points with ``cluster_id``, the last centres, and the passes made.

    Each pass is one scan with a combined aggregation; the driver holds k
    centres only.  Points go to the nearest centre, ties to the lowest; a centre
    without points stays; ``truncate`` cuts means to integers.  It ends when no
    centre changes or after ``passes`` passes; then points get the centres that
    the last assignment was made with.
    """
    names = [f"x{n}" for n in range(len(axes))]

    def assigned(at: list[tuple]) -> DataFrame:
        if not at:
            return points.withColumn("cluster_id", F.lit(None).cast("bigint"))

        def score(c: Column) -> Column:
            total = F.lit(0)
            for n, a in zip(names, axes, strict=True):
                total = total + (F.col(a) - c[n]) * (F.col(a) - c[n])
            return total

        return points.withColumn("cluster_id", nearest(score, at, names))

    used, made = centres, 0
    while centres and made < passes:
        used = centres
        means = {r["cluster_id"]: r for r in assigned(used).groupBy("cluster_id").agg(*[F.avg(a).alias(n) for a, n in zip(axes, names, strict=True)]).collect()}
        made += 1
        centres = [tuple((int if truncate else float)(means[k][n]) for n in names) if k in means else c for k, c in enumerate(used)]
        if centres == used:
            break
    return assigned(used), centres, made


def compact(assignment: DataFrame) -> DataFrame:
    """Cluster ids closed up to 0, 1, ...; the ids present are few, the cells aren't sorted."""
    present = assignment.where("cluster_id IS NOT NULL").select("cluster_id").distinct()
    ranks = present.select("cluster_id", (F.row_number().over(W.orderBy("cluster_id")) - 1).cast("bigint").alias("_new"))
    # One row a cluster, of which there are k.
    return assignment.join(F.broadcast(ranks), "cluster_id", "left").withColumn("cluster_id", F.col("_new")).drop("_new").select(*assignment.columns)
