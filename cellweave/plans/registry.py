"""Grid partitioners by name, and the public calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..operators import graph, grid_centres, grid_walks, measures
from ..operators.grid_forms import FORMS, perlin_query, phyllotaxis_seeds
from ..sources.grids import cells, cells_sql

#: Methods whose cluster is a function of the centres and the cell: rows, cols, k, seed, row, col -> Column.
CENTRES: dict[str, Callable[..., Column]] = {
    "phyllotaxis": lambda r, c, k, s, i, j: grid_centres.phyllotaxis(phyllotaxis_seeds(r, c, k), i, j),
    "voronoi_weighted": lambda r, c, k, s, i, j: grid_centres.voronoi_weighted(grid_centres.weighted_centres(r, c, k, s), i, j),
    "galaxy": lambda r, c, k, s, i, j: grid_centres.galaxy(grid_centres.galaxy_centres(r, c, k, s), i, j),
    "minimal_border": lambda r, c, k, s, i, j: grid_centres.minimal_border(grid_centres.lattice_seeds(r, c, k), i, j),
    "recursive_h": lambda r, c, k, s, i, j: grid_walks.recursive_h(i, j, r, c, k),
}
#: Methods that take rounds, walks or a task of their own.
OTHERS = ("kmeans", "voronoi", "maze", "l_system", "flow_field", "perlin", "spectral")
METHODS = (*FORMS, *CENTRES, *OTHERS)
#: Public operator names and the methods behind them.
PUBLIC = {
    f"grid_{name}_partitioning": name
    for name in ("voronoi", "kmeans", "spectral", "grid", "horizontal", "vertical", "bsp", "circular", "spiral", "diagonal", "checkerboard", "fractal", "honeycomb", "wave")
}
NEAR = ((-1, 0), (1, 0), (0, -1), (0, 1))
DIAGONAL = ((-1, -1), (-1, 1), (1, -1), (1, 1))


def cluster_at(method: str, rows: int, cols: int, k: int, seed: int, i: str, j: str) -> Column:
    """The cluster of a closed-form method at a place given as SQL."""
    if method in CENTRES:
        return CENTRES[method](rows, cols, k, seed, F.expr(i), F.expr(j)).cast("bigint")
    return F.expr(FORMS[method](SPARK, rows, cols, k, i, j)).cast("bigint")


def _checked(method: str, rows: int, cols: int, k: int) -> None:
    if method not in METHODS:
        raise ValueError(f"no method {method!r}")
    if min(rows, cols, k) < 1:
        raise ValueError("rows, columns and clusters must be at least 1")


def partition_grid(spark: SparkSession, rows: int, cols: int, k: int, method: str, seed: int = 42) -> DataFrame:
    """(row, col, cell_id, cluster_id) of all cells; cluster_id is null where a method leaves a cell open."""
    _checked(method, rows, cols, k)
    if method in FORMS or method in CENTRES:
        return cells(spark, rows, cols).withColumn("cluster_id", cluster_at(method, rows, cols, k, seed, "cast(row as bigint)", "cast(col as bigint)"))
    if method == "perlin":
        made = spark.sql(perlin_query(SPARK, cells_sql(SPARK, rows, cols), k, seed))
        return made.select(F.col("i").cast("int").alias("row"), F.col("j").cast("int").alias("col"), "cell_id", "cluster_id")
    if method == "kmeans":
        starts = [divmod(c, cols) for c in grid_centres.start_cells(rows * cols, k, seed)]
        return grid_centres.compact(grid_centres.lloyd(cells(spark, rows, cols), ["row", "col"], starts, truncate=True)[0])
    if method == "spectral":
        return cells(spark, rows, cols).join(graph.grid_spectral(rows, cols, k, spark), "cell_id").select("row", "col", "cell_id", "cluster_id")
    if method == "l_system":
        return grid_walks.l_system(spark, rows, cols, k)
    return {"voronoi": grid_walks.voronoi, "maze": grid_walks.maze, "flow_field": grid_walks.flow_field}[method](spark, rows, cols, k, seed)


def with_adjacent(spark: SparkSession, rows: int, cols: int, k: int, method: str, neighbours: int = 4, seed: int = 42) -> DataFrame:
    """method, row, col, cell_id, cluster_id, adjacent.

    For closed-form methods the neighbours' clusters are the same expression at
    their places, so borders need no shuffle; else windows fetch them.
    """
    if neighbours not in (4, 8):
        raise ValueError("neighbours is 4 or 8")
    _checked(method, rows, cols, k)
    if method not in FORMS and method not in CENTRES:
        return measures.with_adjacent(partition_grid(spark, rows, cols, k, method, seed).select(F.lit(method).alias("method"), "*"), neighbours == 8)
    places = NEAR + DIAGONAL * (neighbours == 8)
    inside = [F.expr(f"row + {a} BETWEEN 0 AND {rows - 1} AND col + {b} BETWEEN 0 AND {cols - 1}") for a, b in places]
    at = [cluster_at(method, rows, cols, k, seed, f"(cast(row as bigint) + {a})", f"(cast(col as bigint) + {b})") for a, b in places]
    base = partition_grid(spark, rows, cols, k, method, seed)
    around = base.withColumn("_around", F.array_compact(F.array(*[F.when(ok, c) for ok, c in zip(inside, at, strict=True)])))
    other = F.array_sort(F.array_distinct(F.filter("_around", lambda x: x != F.col("cluster_id"))))
    adjacent = F.when(F.col("cluster_id").isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(other)
    return around.select(F.lit(method).alias("method"), "row", "col", "cell_id", "cluster_id", adjacent.alias("adjacent"))


def as_lists(assignment: DataFrame) -> DataFrame:
    """(cluster_id, members): cell ids ascending, one row a cluster. For results that fit a row; assignments themselves stay flat."""
    return assignment.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.array_sort(F.collect_list("cell_id")).alias("members"))


def public(spark: SparkSession, name: str, rows: int, cols: int, k: int, neighbours: int = 4) -> DataFrame:
    """A public operator's result as lists. Errors are raised, not turned into empty results."""
    if neighbours not in (4, 8):
        raise ValueError("neighbours is 4 or 8")
    return as_lists(partition_grid(spark, rows, cols, k, PUBLIC[name]))


def grid_partitioning(spark: SparkSession, grid: list[list[int]] | tuple[int, int], k: int, neighbours: int = 4) -> DataFrame:
    """Of nested lists: balanced growth over their dimensions; of (rows, columns): k-means."""
    if isinstance(grid, tuple):
        return public(spark, "grid_kmeans_partitioning", *grid, k, neighbours)
    return public(spark, "grid_voronoi_partitioning", len(grid), len(grid[0]), k, neighbours)


#: The 27 methods that are ranked.
RANKED = (
    "kmeans", "grid", "horizontal", "vertical", "bsp", "circular", "spiral", "voronoi", "diagonal", "checkerboard", "fractal", "honeycomb", "wave", "cross",
    "triangular", "mosaic", "mandelbrot", "concentric", "maze", "rotating_squares", "sierpinski", "phyllotaxis", "interference", "voronoi_weighted", "perlin",
    "galaxy", "minimal_border",
)


def rank(spark: SparkSession, rows: int, cols: int, k: int, methods: tuple[str, ...] = RANKED, neighbours: int = 4) -> DataFrame:
    """Statistics of each method, ranked by border share and size variation; one aggregation over the union."""
    union = None
    for m in methods:
        one = with_adjacent(spark, rows, cols, k, m, neighbours)
        union = one if union is None else union.unionByName(one)
    return measures.ranking(measures.statistics(union))
