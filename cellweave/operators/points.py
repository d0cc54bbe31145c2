"""k-means++ on points (point_id, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.rng import uniform_sql
from .grid_centres import lloyd


def plus_plus(points: DataFrame, k: int, seed: int = 42) -> list[tuple[float, float]]:
    """k starting centres: the first drawn evenly, each next with a chance in proportion to the squared distance to the nearest so far.

    The row of the largest ln(u) / weight is drawn with just that chance, so a
    pass is one aggregation without a running sum.
    """
    centres: list[tuple[float, float]] = []
    for n in range(k):
        u = f"greatest({uniform_sql(SPARK, seed, 'point_id', str(n))}, 1e-12)"
        if not centres:
            weight = F.lit(1.0)
        else:
            literal = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in centres])
            weight = F.array_min(F.transform(literal, lambda c: (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"])))
        key = F.when(weight > 0, F.log(F.expr(u)) / weight)
        r = points.agg(F.max_by(F.struct("x", "y"), F.struct(key, -F.col("point_id"))).alias("c"), F.max(key).alias("key")).first()
        if r["c"] is None:
            break
        if r["key"] is None:  # all points lie on centres
            centres.append(centres[-1])
            continue
        centres.append((float(r["c"]["x"]), float(r["c"]["y"])))
    return centres


def kmeans(points: DataFrame, k: int, passes: int = 100, seed: int = 42) -> DataFrame:
    """(point_id, x, y, cluster_id): k-means++ starts, then passes until no centre changes; ties to the first, empty clusters keep their centre."""
    return lloyd(points.select("point_id", "x", "y"), ["x", "y"], plus_plus(points, k, seed), passes)[0]


def sweep(points: DataFrame, ks=(2, 4, 8, 16, 32, 64), passes: int = 100) -> DataFrame:
    """(k, cluster_id, size, sse) for each k of the sweep."""
    out = None
    for k in ks:
        assigned = kmeans(points, k, passes)
        means = assigned.groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.var_pop("x") * F.count("*") + F.var_pop("y") * F.count("*"), 6).alias("sse")).select(F.lit(k).alias("k"), "*")
        out = means if out is None else out.unionByName(means)
    return out


def centroids(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("size"))


def hue(assigned: DataFrame, k: int) -> DataFrame:
    """assigned with color_hue, for drawing."""
    return assigned.withColumn("color_hue", F.col("cluster_id") / F.lit(float(k)))
