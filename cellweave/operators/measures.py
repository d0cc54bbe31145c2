"""Border cells, cluster sizes, statistics and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = ["method", "row", "col", "cell_id", "cluster_id"]


def neighbour_columns(cells: DataFrame, diagonals: bool = False) -> list[Column]:
    """The clusters of the neighbours in a dense grid, by neighbouring rows of two windows instead of self-joins.

    cells: method, row, col, cluster_id (null: unassigned), every cell present.
    """
    across = W.partitionBy("method", "row").orderBy("col")
    down = W.partitionBy("method", "col").orderBy("row")
    c = F.col("cluster_id")
    out = [F.lag(c).over(across), F.lead(c).over(across), F.lag(c).over(down), F.lead(c).over(down)]
    if diagonals:
        # A cell left or right of the one above or below stands on the diagonal.
        out += [shift(F.col(name)).over(down) for name in ("_left", "_right") for shift in (F.lag, F.lead)]
    return out


def with_adjacent(cells: DataFrame, diagonals: bool = False) -> DataFrame:
    """cells with ``adjacent``: the sorted distinct other clusters that a cell touches."""
    if diagonals:
        across = W.partitionBy("method", "row").orderBy("col")
        cells = cells.withColumns({"_left": F.lag("cluster_id").over(across), "_right": F.lead("cluster_id").over(across)})
    around = F.array_compact(F.array(*neighbour_columns(cells, diagonals)))
    found = cells.withColumn("_around", around)
    other = F.array_sort(F.array_distinct(F.filter("_around", lambda x: x != F.col("cluster_id"))))
    return found.withColumn("adjacent", F.when(F.col("cluster_id").isNull(), F.array().cast("array<bigint>")).otherwise(other.cast("array<bigint>"))).drop("_around", "_left", "_right")


def borders(cells: DataFrame, diagonals: bool = False) -> DataFrame:
    """The cells that touch another cluster, and which."""
    return with_adjacent(cells, diagonals).where(F.size("adjacent") > 0)


def border_counts(cells: DataFrame) -> DataFrame:
    """(method, cluster_id, border_cells): border cells that touch the cluster."""
    return borders(cells).select("method", F.explode("adjacent").alias("cluster_id")).groupBy("method", "cluster_id").agg(F.count("*").alias("border_cells"))


def sizes(cells: DataFrame) -> DataFrame:
    return cells.where("cluster_id IS NOT NULL").groupBy("method", "cluster_id").agg(F.count("*").alias("size"))


def statistics(cells_with_adjacent: DataFrame) -> DataFrame:
    """One row a method: clusters, min_size, max_size, avg_size, stddev_size (population), cv, border_cells, border_pct.

    Sizes and borders come from one aggregation by cluster, combined in each task
    before the shuffle.
    """
    by_cluster = (
        cells_with_adjacent.where("cluster_id IS NOT NULL")
        .groupBy("method", "cluster_id")
        .agg(F.count("*").alias("size"), F.sum(F.when(F.size("adjacent") > 0, 1).otherwise(0)).alias("border"))
    )
    total = by_cluster.groupBy("method").agg(
        F.count("*").alias("clusters"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.avg("size").alias("avg_size"),
        F.stddev_pop("size").alias("stddev_size"),
        F.sum("border").alias("border_cells"),
        F.sum("size").alias("_cells"),
    )
    return total.select(
        "method", "clusters", "min_size", "max_size", F.round("avg_size", 6).alias("avg_size"), F.round("stddev_size", 6).alias("stddev_size"),
        F.round(F.col("stddev_size") / F.col("avg_size"), 6).alias("cv"), "border_cells", F.round(F.col("border_cells") * 100 / F.col("_cells"), 6).alias("border_pct"),
    )


def ranking(stats: DataFrame) -> DataFrame:
    """Methods by border share, then size variation, then name; there are few, so one sort does."""
    order = W.orderBy("border_pct", "cv", "method")
    return stats.select(F.row_number().over(order).alias("rank"), *stats.columns)


#: DuckDB's text for the same over a CTE cells(method, row, col, cell_id, cluster_id).
ADJACENT_SQL = """
around AS (
  SELECT *, lag(cluster_id) OVER x AS w, lead(cluster_id) OVER x AS e, lag(cluster_id) OVER y AS n, lead(cluster_id) OVER y AS s
  FROM cells WINDOW x AS (PARTITION BY method, "row" ORDER BY "col"), y AS (PARTITION BY method, "col" ORDER BY "row")
), adjacent AS (
  SELECT method, "row", "col", cell_id, cluster_id,
         list_sort(list_distinct(list_filter([w, e, n, s], lambda v: v IS NOT NULL AND v <> cluster_id)))::BIGINT[] AS adjacent
  FROM around
)"""

STATS_SQL = """
by_cluster AS (
  SELECT method, cluster_id, count(*) AS size, count(*) FILTER (len(adjacent) > 0) AS border FROM adjacent WHERE cluster_id IS NOT NULL GROUP BY ALL
), stats AS (
  SELECT method, count(*) AS clusters, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS avg_size, round(stddev_pop(size), 6) AS stddev_size,
         round(stddev_pop(size) / avg(size), 6) AS cv, sum(border)::BIGINT AS border_cells, round(sum(border) * 100 / sum(size), 6) AS border_pct
  FROM by_cluster GROUP BY method
)"""
