"""Clustering of soil pores, and the cells between and beside clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import ranked
from ..functions.rng import bits
from .grid_centres import compact, lloyd


def pore_clusters(soil: DataFrame, k: int, passes: int = 100, seed: int = 42) -> DataFrame:
    """soil's columns with cluster_id on pores (null elsewhere): k-means with whole-number centres, ids closed up."""
    pores = soil.where("cell_type = 'PORE'")
    n = pores.count()
    if not n:
        return soil.withColumn("cluster_id", F.lit(None).cast("bigint"))
    # Draws are places in the order of cells; k pores reach the driver.
    chosen, draw = [], 0
    while len(chosen) < min(k, n):
        p = bits(seed, draw) % n
        draw += 1
        if p not in chosen:
            chosen.append(p)
    numbered = ranked(pores, [F.col("cell_id")], "_p").where(F.col("_p").isin(chosen))
    at = {r["_p"]: (r["row"], r["col"]) for r in numbered.collect()}
    found = compact(lloyd(pores, ["row", "col"], [at[p] for p in chosen], passes, truncate=True)[0])
    return soil.join(found.select("cell_id", "cluster_id"), "cell_id", "left").select(*soil.columns, "cluster_id")


def _around(cells: DataFrame, diagonals: bool) -> DataFrame:
    """cells (dense) with ``around``: the clusters up, down, left, right, then on the diagonals, nulls left out."""
    across, down = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")
    c = "cluster_id"
    line = cells.withColumns({"_w": F.lag(c).over(across), "_e": F.lead(c).over(across)})
    parts = [F.lag(c).over(down), F.lead(c).over(down), F.col("_w"), F.col("_e")]
    if diagonals:
        parts += [F.lag("_w").over(down), F.lag("_e").over(down), F.lead("_w").over(down), F.lead("_e").over(down)]
    return line.withColumn("around", F.array_compact(F.array(*parts))).drop("_w", "_e")


def border_cells(cells: DataFrame, diagonals: bool = False) -> DataFrame:
    """Cells that are no pores and touch two or more clusters, and which."""
    near = _around(cells, diagonals).withColumn("adjacent", F.array_sort(F.array_distinct("around")))
    return near.where("cell_type <> 'PORE' AND size(adjacent) >= 2").select("row", "col", "cell_id", "adjacent")


def adjacent_pores(cells: DataFrame, diagonals: bool = False) -> DataFrame:
    """Pores beside a pore of another cluster: their own cluster and the first other one in the order of ``around``."""
    near = _around(cells, diagonals).withColumn("_other", F.filter("around", lambda x: x != F.col("cluster_id")))
    return near.where("cell_type = 'PORE' AND size(_other) > 0").select("row", "col", "cell_id", "cluster_id", F.get("_other", F.lit(0)).alias("other"))


def per_cluster(cells: DataFrame, diagonals: bool = False) -> DataFrame:
    """(cluster_id, pores, border_cells, adjacent_pores): border cells that touch it, pores that lie beside it or in it beside another."""
    sizes = cells.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("pores"))
    border = border_cells(cells, diagonals).select(F.explode("adjacent").alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("border_cells"))
    beside = adjacent_pores(cells, diagonals).select(F.explode(F.array("cluster_id", "other")).alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("adjacent_pores"))
    return sizes.join(border, "cluster_id", "left").join(beside, "cluster_id", "left").na.fill(0, ["border_cells", "adjacent_pores"])


def statistics(cells: DataFrame, diagonals: bool = False) -> DataFrame:
    """One row: clusters, total_pores, min, max and mean size, border and adjacent cells and their shares of all pores."""
    sizes = cells.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("size"))
    shape = sizes.agg(F.count("*").alias("clusters"), F.sum("size").alias("total_pores"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(F.avg("size"), 6).alias("avg_size"))
    border = border_cells(cells, diagonals).agg(F.count("*").alias("border_cells"))
    beside = adjacent_pores(cells, diagonals).agg(F.count("*").alias("adjacent_pores"))
    share = lambda c: F.round(F.col(c) * 100 / F.col("total_pores"), 6)
    return shape.crossJoin(border).crossJoin(beside).select("*", share("border_cells").alias("border_pct"), share("adjacent_pores").alias("adjacent_pct"))
