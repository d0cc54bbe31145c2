"""The library's queries: name -> function of (spark, sf_dir), and the same in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK, SPARK
from ..functions.frames import ranked
from ..functions.rng import bits_sql
from ..operators import agents, dag, graph, grid_centres, grid_walks, measures, points, soil
from ..operators.grid_forms import FORMS, boxes_bsp, perlin_query, phyllotaxis_seeds
from ..sources import grids, sinks, trees
from ..sources import points as point_sets
from . import registry

ROWS, COLS, K = 100, 100, 8
#: The grid of events: users modulo 30 by hour.
EVENT_ROWS, EVENT_COLS = 30, 24
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


# Array columns become text, joined by commas, so that engines can be compared.


def _flat(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({n: F.array_join(n, ",") for n, kind in df.dtypes if kind.startswith("array")})

    return run


def query(name: str, sql: str | None = None, arrays: str = ""):
    """Register a query and its SQL; arrays names the SQL's array columns."""

    def add(f):
        QUERIES[name] = _flat(f)
        if sql:
            texts = ", ".join(f"array_to_string({a}, ',') AS {a}" for a in arrays.split())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({sql}) AS flat" if texts else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- grids: assignments ----------------------------------------------------------------------------------------------

_NAMES = 'cast(i as int) AS "row", cast(j as int) AS "col", cell_id'
_CELLS = grids.cells_sql(DUCK, ROWS, COLS)


def _nearest_sql(values: str, names: str, score: str, cells: str = _CELLS) -> str:
    return f"SELECT {_NAMES}, arg_min(k, ({score}, k))::BIGINT AS cluster_id FROM {cells} AS g CROSS JOIN (VALUES {values}) AS c({names}) GROUP BY i, j, cell_id"


def _values(rows) -> str:
    return ", ".join(f"({', '.join(f'{v!r}e0' if isinstance(v, float) and 'e' not in repr(v) else repr(v) for v in r)}, {n})" for n, r in enumerate(rows))


_SQUARE = "(i - r) * (i - r) + (j - c) * (j - c)"


def lloyd_sql(start: str, data: str, axes: tuple[str, ...], passes: int, truncate: bool, keys: str) -> str:
    """Lloyd's passes by recursion: start has (k, axes), data has keys and axes."""
    mean = (lambda a: f"trunc(avg(d.{a}))") if truncate else (lambda a: f"avg(d.{a})")
    dist = " + ".join(f"(d.{a} - m.{a}) * (d.{a} - m.{a})" for a in axes)
    cols = ", ".join(axes)
    near = f"SELECT {keys}, {', '.join(f'd.{a} AS {a}' for a in axes)}, arg_min(m.k, ({dist}, m.k)) AS k FROM d CROSS JOIN {{m}} AS m GROUP BY ALL"
    return f"""
WITH RECURSIVE d AS ({data}), m0 AS ({start}), m(p, k, {cols}) AS (
  SELECT 0, k, {', '.join(f'{a}::DOUBLE' for a in axes)} FROM m0
  UNION ALL
  SELECT m.p + 1, m.k, {', '.join(f'coalesce(n.{a}, m.{a})' for a in axes)}
  FROM m LEFT JOIN (SELECT d.k, {', '.join(f'{mean(a)} AS {a}' for a in axes)} FROM ({near.format(m='m')}) AS d GROUP BY d.k) AS n ON n.k = m.k
  WHERE m.p < {passes - 1}
), last AS (SELECT k, {cols} FROM m WHERE p = {passes - 1}), assigned AS ({near.format(m='last')})
"""


def _grid_sql(method: str) -> str | None:
    if method in FORMS:
        return f"SELECT {_NAMES}, cast({FORMS[method](DUCK, ROWS, COLS, K, 'i', 'j')} as bigint) AS cluster_id FROM {_CELLS} AS g"
    if method == "perlin":
        return f"SELECT {_NAMES}, cluster_id FROM ({perlin_query(DUCK, _CELLS, K)}) AS g"
    if method == "phyllotaxis":
        return _nearest_sql(_values(phyllotaxis_seeds(ROWS, COLS, K)), "r, c, k", _SQUARE)
    if method == "voronoi_weighted":
        return _nearest_sql(_values(grid_centres.weighted_centres(ROWS, COLS, K)), "r, c, w, k", f"sqrt({_SQUARE}) / w")
    if method == "galaxy":
        d = f"sqrt({_SQUARE})"
        return _nearest_sql(_values(grid_centres.galaxy_centres(ROWS, COLS, K)), "r, c, a, t, k", f"{d} - t * (atan2(i - r, j - c) - a) * sqrt({d})")
    if method == "minimal_border":
        return _nearest_sql(_values(grid_centres.lattice_seeds(ROWS, COLS, K)), "r, c, k", "abs(i - r) + abs(j - c)")
    if method == "recursive_h":
        boxes = ", ".join(f"({t}, {left}, {h}, {w}, {k}, {n})" for n, (t, left, h, w, k) in enumerate(grid_walks.h_bars(ROWS, COLS, K)))
        hit = "(j = l + w // 2 AND i >= t AND i < t + h) OR (i = t + h // 2 AND j >= l AND j < l + w)"
        return f"SELECT {_NAMES}, max_by(k, n)::BIGINT AS cluster_id FROM {_CELLS} AS g LEFT JOIN (VALUES {boxes}) AS b(t, l, h, w, k, n) ON {hit} GROUP BY i, j, cell_id"
    if method == "l_system":
        painted = ", ".join(f"({r}, {c}, {k})" for (r, c), k in grid_walks.l_system_path(ROWS, COLS, K).items())
        return f"SELECT {_NAMES}, arg_min(k, (abs(i - r) + abs(j - c), k))::BIGINT AS cluster_id FROM {_CELLS} AS g CROSS JOIN (VALUES {painted}) AS p(r, c, k) GROUP BY i, j, cell_id"
    if method == "kmeans":
        start = ", ".join(f"({c // COLS}, {c % COLS}, {n})" for n, c in enumerate(grid_centres.start_cells(ROWS * COLS, K)))
        body = lloyd_sql(f"SELECT * FROM (VALUES {start}) AS v(i, j, k)", f"SELECT * FROM {_CELLS} AS g", ("i", "j"), 100, True, "cell_id")
        return body + f"SELECT {_NAMES}, (dense_rank() OVER (ORDER BY k) - 1)::BIGINT AS cluster_id FROM assigned"
    return None


for _method in registry.METHODS:
    if _method != "spectral":
        query(f"grid_{_method}", _grid_sql(_method))(lambda spark, _, m=_method: registry.partition_grid(spark, ROWS, COLS, K, m))
query("grid_spectral")(lambda spark, _: registry.partition_grid(spark, 20, 20, 4, "spectral"))
query("grid_bsp_boxes", f"SELECT cell.* FROM (SELECT {_NAMES}, k::BIGINT AS cluster_id FROM {_CELLS} AS g JOIN (VALUES {', '.join(map(str, boxes_bsp(ROWS, COLS, 6)))}) AS b(t, l, e, r, k) ON i >= t AND i < e AND j >= l AND j < r) AS cell")(
    lambda spark, _: registry.partition_grid(spark, ROWS, COLS, 6, "bsp")
)
for _name, _method in registry.PUBLIC.items():
    _sql = _grid_sql(_method)
    if _method == "spectral":
        query(_name)(lambda spark, _, n=_name: registry.public(spark, n, 20, 20, 4))
    else:
        query(_name, _sql and f"SELECT cluster_id, list(cell_id ORDER BY cell_id) AS members FROM ({_sql}) AS a GROUP BY cluster_id", "members")(lambda spark, _, n=_name: registry.public(spark, n, ROWS, COLS, K))
query("grid_partitioning_of_lists")(lambda spark, _: registry.grid_partitioning(spark, [[0] * 30 for _ in range(20)], 6))
query("grid_from_lists", "SELECT (i // 4)::INT AS \"row\", (i % 4)::INT AS \"col\", i AS cell_id, (i * i)::BIGINT AS weight FROM range(12) r(i)")(lambda spark, _: grids.from_lists(spark, [[(r * 4 + c) ** 2 for c in range(4)] for r in range(3)]).withColumn("weight", F.col("weight").cast("bigint")))


# ---- grids: measures and ranking -------------------------------------------------------------------------------------

SQL_RANKED = tuple(m for m in registry.RANKED if m not in ("voronoi", "maze"))
_UNION = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({_grid_sql(m)}) AS a" for m in SQL_RANKED if m != "kmeans")
_FLAT = tuple(m for m in SQL_RANKED if m != "kmeans")
_FOUR = ("grid", "horizontal", "bsp", "diagonal", "checkerboard", "mosaic")


def _methods_sql(methods) -> str:
    return "cells AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({_grid_sql(m)}) AS a" for m in methods) + ")"


_RANK = 'SELECT row_number() OVER (ORDER BY border_pct, cv, method) AS rank, * FROM stats'
query("rank_grid_methods", f"WITH {_methods_sql(_FLAT)}, {measures.ADJACENT_SQL}, {measures.STATS_SQL} {_RANK}")(lambda spark, _: registry.rank(spark, ROWS, COLS, K, _FLAT))
query("rank_all_grid_methods")(lambda spark, _: registry.rank(spark, ROWS, COLS, K))


def _some(spark: SparkSession) -> DataFrame:
    out = None
    for m in _FOUR:
        one = registry.partition_grid(spark, ROWS, COLS, K, m).select(F.lit(m).alias("method"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_SOME = f"WITH {_methods_sql(_FOUR)}"
query("cluster_stats", f"{_SOME}, {measures.ADJACENT_SQL}, {measures.STATS_SQL} SELECT * FROM stats")(lambda spark, _: measures.statistics(measures.with_adjacent(_some(spark))))
query("grid_borders", f"{_SOME}, {measures.ADJACENT_SQL} SELECT * FROM adjacent WHERE len(adjacent) > 0", "adjacent")(lambda spark, _: measures.borders(_some(spark)))
query("border_cells_per_cluster", f"{_SOME}, {measures.ADJACENT_SQL} SELECT method, cluster_id, count(*) AS border_cells FROM (SELECT method, unnest(adjacent) AS cluster_id FROM adjacent) AS u GROUP BY ALL")(lambda spark, _: measures.border_counts(_some(spark)))
query("cluster_sizes", f"{_SOME} SELECT method, cluster_id, count(*) AS size FROM cells GROUP BY ALL")(lambda spark, _: measures.sizes(_some(spark)))
_EIGHT = " OR ".join(f"(b.\"row\" = a.\"row\" + {x} AND b.\"col\" = a.\"col\" + {y})" for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y)
query("grid_borders_diagonal", f"WITH cells AS (SELECT 'honeycomb' AS method, * FROM ({_grid_sql('honeycomb')}) AS a) SELECT a.method, a.\"row\", a.\"col\", a.cell_id, a.cluster_id, list(DISTINCT b.cluster_id ORDER BY b.cluster_id) AS adjacent FROM cells a JOIN cells b ON b.cell_id - a.cell_id IN (-{COLS + 1}, -{COLS}, -{COLS - 1}, -1, 1, {COLS - 1}, {COLS}, {COLS + 1}) AND abs(a.\"col\" - b.\"col\") <= 1 AND a.cluster_id <> b.cluster_id GROUP BY ALL", "adjacent")(
    lambda spark, _: registry.with_adjacent(spark, ROWS, COLS, K, "honeycomb", 8).where(F.size("adjacent") > 0)
)


# ---- sources ---------------------------------------------------------------------------------------------------------

for _name in grids.ALL_WEIGHTS:
    query(f"weights_{_name}", grids.weights_sql(DUCK, _name, ROWS, COLS))(lambda spark, _, n=_name: grids.weights(spark, n, ROWS, COLS))
query("mask_random", grids.random_mask_sql(DUCK, 150, 150))(lambda spark, _: spark.sql(grids.random_mask_sql(SPARK, 150, 150)))
query("mask_discs", grids.disc_mask_sql(DUCK, ROWS, COLS))(lambda spark, _: spark.sql(grids.disc_mask_sql(SPARK, ROWS, COLS)))
query("soil_random", grids.soil_sql(DUCK, ROWS, COLS))(lambda spark, _: spark.sql(grids.soil_sql(SPARK, ROWS, COLS)))
query("nematodes", grids.nematodes_sql(DUCK, grids.soil_sql(DUCK, ROWS, COLS), 50))(lambda spark, _: grids.nematodes(spark.sql(grids.soil_sql(SPARK, ROWS, COLS)), 50))
query("grid_constant", f"SELECT {_NAMES} FROM {_CELLS} AS g")(lambda spark, _: grids.cells(spark, ROWS, COLS))
_XY = "SELECT point_id, round(x, 6) AS x, round(y, 6) AS y FROM ({}) AS p"
for _name in point_sets.DATASETS:
    query(f"points_{_name}", _XY.format(point_sets.dataset_sql(DUCK, _name)))(lambda spark, _, n=_name: spark.sql(_XY.format(point_sets.dataset_sql(SPARK, n))))
query("points_uniform", _XY.format(point_sets.uniform_points_sql(DUCK, 1000, 1000, 1000)))(lambda spark, _: spark.sql(_XY.format(point_sets.uniform_points_sql(SPARK, 1000, 1000, 1000))))
query("points_uniform_coverage")(lambda spark, _: point_sets.uniform_coverage(spark))
query("random_reverse_tree", trees.random_reverse_tree_sql(DUCK, 200))(lambda spark, _: trees.random_reverse_tree(spark, 200))
query("replay_tree", trees.REPLAY_SQL)(lambda spark, d: trees.replay_tree(table(spark, d, "orders")))
_STEP = 10**12
_GEO = f"""
SELECT child AS ord, child, parent FROM (
  SELECT r_regionkey::BIGINT + {_STEP} AS child, 0::BIGINT AS parent FROM region
  UNION ALL SELECT n_nationkey::BIGINT + {2 * _STEP}, n_regionkey::BIGINT + {_STEP} FROM nation
  UNION ALL SELECT c_custkey + {3 * _STEP}, c_nationkey::BIGINT + {2 * _STEP} FROM customer
  UNION ALL SELECT o_orderkey + {4 * _STEP}, o_custkey + {3 * _STEP} FROM orders)
"""


def _geo(spark: SparkSession, d: str) -> DataFrame:
    return trees.geo_tree(*[table(spark, d, t) for t in ("region", "nation", "customer", "orders")])


query("geo_tree", _GEO)(_geo)


# ---- weighted grids and agents ---------------------------------------------------------------------------------------


def event_grid(spark: SparkSession, d: str) -> DataFrame:
    """row, col, cell_id, weight: events by user and hour; cells without any have 0."""
    events = table(spark, d, "events")
    at = events.groupBy((F.col("user_id") % EVENT_ROWS).cast("int").alias("row"), F.hour("ts").alias("col")).agg(F.count("*").alias("weight"))
    return grids.cells(spark, EVENT_ROWS, EVENT_COLS).join(at, ["row", "col"], "left").select("row", "col", "cell_id", F.coalesce("weight", F.lit(0)).alias("weight"))


def purchase_mask(spark: SparkSession, d: str) -> DataFrame:
    """row, col, cell_id, is_agent: whether the cell of events has a purchase."""
    bought = table(spark, d, "events").where("event_type = 'purchase'").select((F.col("user_id") % EVENT_ROWS).cast("int").alias("row"), F.hour("ts").alias("col")).distinct()
    return grids.cells(spark, EVENT_ROWS, EVENT_COLS).join(bought.withColumn("_b", F.lit(True)), ["row", "col"], "left").select("row", "col", "cell_id", F.coalesce("_b", F.lit(False)).alias("is_agent"))


_EVENTS = f"""(SELECT i, j, cell_id, count(event_id) AS weight, bool_or(coalesce(event_type = 'purchase', false)) AS is_agent
  FROM {grids.cells_sql(DUCK, EVENT_ROWS, EVENT_COLS)} AS g LEFT JOIN events ON user_id % {EVENT_ROWS} = i AND hour(ts) = j GROUP BY i, j, cell_id)"""
query("events_grid", f"SELECT {_NAMES}, weight FROM {_EVENTS} AS e")(event_grid)
query("purchase_mask", f"SELECT {_NAMES}, is_agent FROM {_EVENTS} AS e")(lambda spark, d: grids.checked_mask(purchase_mask(spark, d), EVENT_ROWS, EVENT_COLS))
_SEEDED = f"SELECT i, j, cell_id, weight, arg_min(k, ({_SQUARE}, k))::BIGINT AS cluster_id FROM {_EVENTS} AS e CROSS JOIN (VALUES {_values(agents.lattice(EVENT_ROWS, EVENT_COLS, 9))}) AS c(r, c, k) GROUP BY ALL"


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    return agents.seeded(event_grid(spark, d), EVENT_ROWS, EVENT_COLS, 9)


query("weighted_seeds", f"SELECT {_NAMES}, weight, cluster_id FROM ({_SEEDED}) AS s")(_seeded)
query("weighted_partition")(lambda spark, d: agents.partition_weighted(event_grid(spark, d), EVENT_ROWS, EVENT_COLS, 9))
query("cluster_weights", f"SELECT cluster_id, sum(weight)::BIGINT AS weight, count(*) AS cells FROM ({_SEEDED}) AS s GROUP BY 1")(lambda spark, d: agents.cluster_weights(_seeded(spark, d)))
query("average_weight", f"SELECT (sum(weight) // 9)::BIGINT AS avg_weight FROM ({_SEEDED}) AS s")(lambda spark, d: event_grid(spark, d).agg(F.expr("sum(weight) div 9").alias("avg_weight")))
query("cluster_distribution", f"SELECT cluster_id, sum(weight)::BIGINT AS weight, count(*) AS cells, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS share FROM ({_SEEDED}) AS s GROUP BY 1")(lambda spark, d: agents.cluster_distribution(_seeded(spark, d)))
_BESIDE = "list_filter([lag(cluster_id) OVER x, lead(cluster_id) OVER x, lag(cluster_id) OVER y, lead(cluster_id) OVER y], lambda v: v IS NOT NULL)"
_WIN = "WINDOW x AS (PARTITION BY i ORDER BY j), y AS (PARTITION BY j ORDER BY i)"
query("neighbour_clusters", f"SELECT {_NAMES}, cluster_id, list_sort(list_distinct(list_append({_BESIDE}, cluster_id))) AS clusters FROM ({_SEEDED}) AS s {_WIN}", "clusters")(
    lambda spark, d: agents.surroundings(_seeded(spark, d)).select("row", "col", "cell_id", "cluster_id", F.array_sort(F.array_distinct(F.array_append("beside", F.col("cluster_id")))).alias("clusters"))
)
query(
    "cluster_metrics",
    f"""WITH s AS ({_SEEDED}), w AS (SELECT cluster_id, sum(weight) AS w FROM s GROUP BY 1), a AS (SELECT sum(w) // 9 AS a FROM w),
near AS (SELECT len(list_distinct(list_append({_BESIDE}, cluster_id))) AS n FROM s {_WIN})
SELECT any_value(a)::BIGINT AS avg_weight, round(max(abs(w - a) / a), 6) AS max_weight_deviation, (SELECT round(avg(n), 6) FROM near) AS avg_connectivity FROM w, a""",
)(lambda spark, d: agents.cluster_metrics(_seeded(spark, d), 9))
query(
    "spatial_coherence",
    f"""WITH s AS ({_SEEDED}) SELECT a.i::INT AS "row", a.j::INT AS "col", a.cell_id, a.cluster_id,
round(avg(CASE WHEN b.cluster_id = a.cluster_id THEN 1 ELSE 0 END), 6) AS coherence
FROM s a JOIN s b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 AND a.cell_id <> b.cell_id GROUP BY ALL""",
)(lambda spark, d: agents.coherence(_seeded(spark, d)).select("row", "col", "cell_id", "cluster_id", F.round("coherence", 6).alias("coherence")))
query("weight_imbalance", f"SELECT (max(coalesce(w, 0)) - min(coalesce(w, 0)))::BIGINT AS imbalance FROM range(9) LEFT JOIN (SELECT cluster_id, sum(weight) AS w FROM ({_SEEDED}) AS s GROUP BY 1) ON range = cluster_id")(lambda spark, d: agents.imbalance(_seeded(spark, d), 9))
query("missing_clusters", f"SELECT range AS cluster_id FROM range(12) ANTI JOIN ({_SEEDED}) AS s ON range = cluster_id")(lambda spark, d: agents.missing_clusters(_seeded(spark, d), 12))
query("agents_lattice")(lambda spark, d: agents.partition_agents(purchase_mask(spark, d), EVENT_ROWS, EVENT_COLS, 4))
query("agents_lattice_gated")(lambda spark, d: agents.partition_agents(purchase_mask(spark, d), EVENT_ROWS, EVENT_COLS, 4, gate=1))
query("agents_frontier")(lambda spark, d: agents.partition_agents_frontier(purchase_mask(spark, d), EVENT_ROWS, EVENT_COLS, 8))
_AGENTS = f"SELECT i, j, cell_id, CASE WHEN is_agent THEN (i // 10 * 3 + j // 8)::BIGINT END AS cluster_id FROM {_EVENTS} AS e"


def _agent_cells(spark: SparkSession, d: str) -> DataFrame:
    """Agents in blocks of 10 by 8 cells, as a fixed assignment to measure."""
    return purchase_mask(spark, d).withColumn("cluster_id", F.expr("CASE WHEN is_agent THEN cast(row div 10 * 3 + col div 8 as bigint) END")).drop("is_agent")


query("agent_counts", f"SELECT cluster_id, count(*) AS agents FROM ({_AGENTS}) AS a WHERE cluster_id IS NOT NULL GROUP BY 1")(lambda spark, d: _agent_cells(spark, d).where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("agents")))
query(
    "frontier_cells",
    f"""WITH b AS (SELECT i, j, cell_id, cluster_id, {_BESIDE} AS beside FROM ({_AGENTS}) AS a {_WIN}),
p AS (SELECT *, len(list_filter(beside, lambda v: v <> cluster_id)) AS n FROM b WHERE cluster_id IS NOT NULL)
SELECT {_NAMES}, cluster_id, round(n / len(beside), 6) AS penalty FROM p WHERE n > 0""",
)(lambda spark, d: agents.frontier(_agent_cells(spark, d)))
query(
    "agent_coherence",
    f"""WITH a AS ({_AGENTS}) SELECT a.i::INT AS "row", a.j::INT AS "col", a.cell_id, a.cluster_id,
round(coalesce(avg(CASE WHEN b.cluster_id = a.cluster_id THEN 1 WHEN b.cluster_id IS NOT NULL THEN 0 END), 0), 6) AS coherence
FROM a LEFT JOIN a b ON b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 AND a.cell_id <> b.cell_id WHERE a.cluster_id IS NOT NULL GROUP BY ALL""",
)(lambda spark, d: agents.coherence(_agent_cells(spark, d)).where("cluster_id IS NOT NULL").select("row", "col", "cell_id", "cluster_id", F.round("coherence", 6).alias("coherence")))
query(
    "agent_neighbour_clusters",
    f"""WITH a AS ({_AGENTS}), p AS (SELECT a.i, a.j, a.cell_id, a.cluster_id, b.cluster_id AS other
FROM a LEFT JOIN a b ON abs(b.i - a.i) + abs(b.j - a.j) = 1 WHERE a.cluster_id IS NOT NULL)
SELECT {_NAMES}, cluster_id, list_sort(list_distinct(list(other))) AS clusters FROM p GROUP BY i, j, cell_id, cluster_id""",
    "clusters",
)(lambda spark, d: agents.surroundings(_agent_cells(spark, d)).where("cluster_id IS NOT NULL").select("row", "col", "cell_id", "cluster_id", F.array_sort(F.array_distinct("beside")).alias("clusters")))
query("communication_edges", f"WITH a AS ({_AGENTS}) SELECT count(*) AS communication_edges FROM a JOIN a b ON (b.cell_id = a.cell_id + 1 AND b.i = a.i OR b.cell_id = a.cell_id + {EVENT_COLS}) AND a.cluster_id <> b.cluster_id")(lambda spark, d: agents.communication(_agent_cells(spark, d)))


# ---- soil ------------------------------------------------------------------------------------------------------------


def part_soil(spark: SparkSession, d: str) -> DataFrame:
    """row, col, cell_id, cell_type: parts in rows of 40 by key; every place of the rows exists, those without a part are MINERAL."""
    parts = table(spark, d, "part")
    last = parts.agg(F.max("p_partkey")).first()[0] or 0
    kind = F.element_at(F.array(*map(F.lit, grids.KINDS)), F.col("p_size") % 3 + 1)
    return grids.cells(spark, int(last) // 40 + 1, 40).join(parts.select(F.col("p_partkey").alias("cell_id"), kind.alias("t")), "cell_id", "left").select("row", "col", "cell_id", F.coalesce("t", F.lit("MINERAL")).alias("cell_type"))


_SOIL = f"""(SELECT range // 40 AS i, range % 40 AS j, range AS cell_id, CASE p_size % 3 WHEN 0 THEN 'PORE' WHEN 1 THEN 'MINERAL' WHEN 2 THEN 'ORGANIC' ELSE 'MINERAL' END AS cell_type
  FROM (SELECT unnest(range((SELECT (max(p_partkey) // 40 + 1) * 40 FROM part))) AS range) AS r LEFT JOIN part ON p_partkey = range)"""
_BANDS = f"SELECT i, j, cell_id, cell_type, CASE WHEN cell_type = 'PORE' THEN ((i // 8 + j // 8) % 4)::BIGINT END AS cluster_id FROM {_SOIL} AS s"


def _banded(spark: SparkSession, d: str) -> DataFrame:
    """Pores in diagonal blocks, as a fixed assignment to measure."""
    return part_soil(spark, d).withColumn("cluster_id", F.expr("CASE WHEN cell_type = 'PORE' THEN cast((row div 8 + col div 8) % 4 as bigint) END"))


_AROUND = "list_filter([lag(cluster_id) OVER y, lead(cluster_id) OVER y, lag(cluster_id) OVER x, lead(cluster_id) OVER x], lambda v: v IS NOT NULL)"
_NEAR = f"near AS (SELECT *, {_AROUND} AS around FROM ({_BANDS}) AS b {_WIN})"
_BORDER = "border AS (SELECT *, list_sort(list_distinct(around)) AS adjacent FROM near WHERE cell_type <> 'PORE' AND len(list_distinct(around)) >= 2)"
_ADJ = "beside AS (SELECT *, list_filter(around, lambda v: v <> cluster_id)[1] AS other FROM near WHERE cell_type = 'PORE' AND len(list_filter(around, lambda v: v <> cluster_id)) > 0)"
query("part_soil", f"SELECT {_NAMES}, cell_type FROM {_SOIL} AS s")(part_soil)
query("soil_border_cells", f"WITH {_NEAR}, {_BORDER} SELECT {_NAMES}, adjacent FROM border", "adjacent")(lambda spark, d: soil.border_cells(_banded(spark, d)))
query("soil_adjacent_pores", f"WITH {_NEAR}, {_ADJ} SELECT {_NAMES}, cluster_id, other FROM beside")(lambda spark, d: soil.adjacent_pores(_banded(spark, d)))
query(
    "soil_per_cluster",
    f"""WITH {_NEAR}, {_BORDER}, {_ADJ}, n AS (SELECT cluster_id, count(*) AS pores FROM near WHERE cluster_id IS NOT NULL GROUP BY 1),
b AS (SELECT cluster_id, count(*) AS n FROM (SELECT unnest(adjacent) AS cluster_id FROM border) AS u GROUP BY 1), a AS (SELECT cluster_id, count(*) AS n FROM (SELECT unnest([cluster_id, other]) AS cluster_id FROM beside) AS u GROUP BY 1)
SELECT n.cluster_id, pores, coalesce(b.n, 0) AS border_cells, coalesce(a.n, 0) AS adjacent_pores FROM n LEFT JOIN b USING (cluster_id) LEFT JOIN a USING (cluster_id)""",
)(lambda spark, d: soil.per_cluster(_banded(spark, d)))
query(
    "soil_stats",
    f"""WITH {_NEAR}, {_BORDER}, {_ADJ}, n AS (SELECT cluster_id, count(*) AS n FROM near WHERE cluster_id IS NOT NULL GROUP BY 1),
b AS (SELECT count(*) AS b FROM border), a AS (SELECT count(*) AS a FROM beside)
SELECT count(*) AS clusters, sum(n)::BIGINT AS total_pores, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS avg_size, any_value(b) AS border_cells, any_value(a) AS adjacent_pores,
round(any_value(b) * 100 / sum(n), 6) AS border_pct, round(any_value(a) * 100 / sum(n), 6) AS adjacent_pct FROM n, a, b""",
)(lambda spark, d: soil.statistics(_banded(spark, d)))
query("soil_clusters")(lambda spark, d: soil.pore_clusters(part_soil(spark, d), 16))
query("soil_lists")(lambda spark, d: registry.as_lists(soil.pore_clusters(part_soil(spark, d), 16)))


# ---- graphs ----------------------------------------------------------------------------------------------------------

N = 60
_TREE = f"(SELECT parent AS src, child AS dst FROM ({trees.random_reverse_tree_sql(DUCK, N)}) AS t)"


def _tree(spark: SparkSession) -> DataFrame:
    return trees.attachment_tree(spark, N)


def supply_graph(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): suppliers and parts of line items, parts shifted behind the suppliers' keys."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10**9).alias("dst")).distinct()


_BLOCKS = f"(SELECT range AS id, (range % 7) % 4 AS cluster_id FROM range({N}))"


def _blocks(spark: SparkSession) -> DataFrame:
    return spark.range(N).select("id", F.expr("cast((id % 7) % 4 as bigint)").alias("cluster_id"))


query("attachment_tree", f"SELECT src, dst FROM {_TREE} AS t")(lambda spark, _: _tree(spark))
query("supply_graph", "SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000 AS dst FROM lineitem")(supply_graph)
_COMPONENTS = """WITH RECURSIVE g AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000 AS dst FROM lineitem), e AS (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g),
r AS (
  SELECT DISTINCT a AS id, a AS t, 0 AS p FROM e
  UNION ALL
  SELECT id, t, p FROM (
    SELECT *, bool_or(t < old) OVER () AS moved
    FROM (SELECT o.id, o.t AS old, o.p + 1 AS p, least(o.t, min(n.t)) AS t FROM r o JOIN e ON e.a = o.id JOIN r n ON n.id = e.b GROUP BY o.id, o.t, o.p) AS s
  ) AS m WHERE moved
) SELECT id, arg_max(t, p) AS component FROM r GROUP BY id"""


def supply_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the whole graph of suppliers and parts."""
    g = supply_graph(spark, d)
    return graph.components(graph.vertices_of(g), g)


for _name in ("connected_components", "supply_components"):
    query(_name, _COMPONENTS)(supply_components)


def _vertices(spark: SparkSession) -> DataFrame:
    """The layout's vertices, each its own colour."""
    return graph.layout(_tree(spark), N).withColumn("cluster_id", F.col("id"))


query("cluster_png")(lambda spark, _: sinks.png_strips(sinks.cluster_pixels(registry.partition_grid(spark, ROWS, COLS, K, "honeycomb"))))
query("events_png")(lambda spark, d: sinks.png_strips(sinks.weight_pixels(QUERIES["events_grid"](spark, d), "weight")))
query("points_png")(lambda spark, _: sinks.png_strips(sinks.point_pixels(_vertices(spark), 200)))
query("graph_png")(lambda spark, _: sinks.png_strips(sinks.graph_pixels(_vertices(spark), _tree(spark), 200)))
query("graph_layout")(lambda spark, _: graph.layout(_tree(spark), N))
query("graph_kmeans_layout")(lambda spark, _: graph.kmeans_layout(graph.layout(_tree(spark), N), 5, N))
query("graph_label_propagation")(lambda spark, _: graph.label_propagation(spark.range(N), _tree(spark), 5))
query("graph_spectral")(lambda spark, _: graph.spectral(_tree(spark), 5, N))
query("graph_edge_betweenness")(lambda spark, _: graph.edge_betweenness(_tree(spark), 4, N))
query(
    "graph_edge_scores",
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {_TREE}), below AS (SELECT dst AS top, dst AS v FROM e UNION ALL SELECT b.top, e.dst FROM below b JOIN e ON e.src = b.v)
SELECT src, dst, ((n - 1) * ({N} - n - 1))::BIGINT AS score FROM e JOIN (SELECT top, count(*) AS n FROM below GROUP BY top) ON top = dst""",
)(lambda spark, _: graph.edge_scores(_tree(spark), N))
query("graph_walktrap")(lambda spark, _: graph.walktrap(_tree(spark), 5, N))
query("graph_random_walk")(lambda spark, _: graph.random_walk(_tree(spark), 5, N))
query(
    "graph_score",
    f"""WITH n AS (SELECT cluster_id, count(*) AS n FROM {_BLOCKS} GROUP BY 1), s AS (SELECT count(*) AS clusters, stddev_pop(n) / avg(n) AS cv, sum(n) AS v FROM n),
c AS (SELECT count(*) AS c FROM {_TREE} JOIN {_BLOCKS} a ON src = a.id JOIN {_BLOCKS} b ON dst = b.id WHERE a.cluster_id <> b.cluster_id)
SELECT c AS cut_edges, clusters, round(cv, 6) AS size_cv, round(c * 0.7 + cv * v * 0.3, 6) AS score FROM c, s""",
)(lambda spark, _: graph.score(_tree(spark), _blocks(spark)))


def rank_graph(spark: SparkSession, _: str) -> DataFrame:
    """The clusterings of one graph by score."""
    edges, found = _tree(spark), None
    ways = {
        "kmeans": lambda: graph.kmeans_layout(graph.layout(edges, N), 5, N),
        "label_propagation": lambda: graph.label_propagation(spark.range(N), edges, 5),
        "spectral": lambda: graph.spectral(edges, 5, N),
        "edge_betweenness": lambda: graph.edge_betweenness(edges, 5, N),
        "walktrap": lambda: graph.walktrap(edges, 5, N),
        "random_walk": lambda: graph.random_walk(edges, 5, N),
    }
    for name, way in ways.items():
        one = graph.score(edges, way()).select(F.lit(name).alias("method"), "*")
        found = one if found is None else found.unionByName(one)
    return found.selectExpr("row_number() OVER (ORDER BY score, method) AS rank", "*")


query("rank_graph_methods")(rank_graph)
query(
    "adjacency_matrix",
    f"""WITH e AS (SELECT src, dst FROM {_TREE} UNION SELECT dst, src FROM {_TREE}), v AS (SELECT range AS v FROM range({N}))
SELECT a.v AS id, string_agg(CASE WHEN src IS NULL THEN '0' ELSE '1' END, ' ' ORDER BY b.v) AS line FROM v a CROSS JOIN v b LEFT JOIN e ON src = a.v AND dst = b.v GROUP BY 1""",
)(lambda spark, _: graph.adjacency_lines(_tree(spark), N))


# ---- DAGs and trees --------------------------------------------------------------------------------------------------


def _levels_sql(edges: str) -> str:
    """Longest-path levels and the keys of a first-in-first-out peel, by all ways from the roots (for graphs with few)."""
    return f"""e AS (SELECT * FROM {edges} AS x), nodes AS (SELECT parent AS node FROM e UNION SELECT child FROM e),
ways AS (
  SELECT node::BIGINT AS node, 0 AS level, [node::BIGINT] AS key FROM nodes WHERE node NOT IN (SELECT child FROM e)
  UNION ALL SELECT e.child::BIGINT, level + 1, list_append(key, e.ord::BIGINT) FROM ways JOIN e ON e.parent = ways.node
), topo AS (SELECT node, max(level) AS level, max_by(key, (level, key)) AS key FROM ways GROUP BY node),
ordered AS (SELECT node, level, row_number() OVER (ORDER BY level, key) - 1 AS rank FROM topo)"""


_RIVER = trees.values_sql("river")
_REPLAY = f"({trees.REPLAY_SQL})"
_EVEN = "CASE WHEN rank < (n % {k}) * (n // {k} + 1) THEN rank // (n // {k} + 1) ELSE n % {k} + (rank - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"
_COUNTED = "(SELECT *, count(*) OVER () AS n FROM ordered) AS o"


def _river(spark: SparkSession) -> DataFrame:
    return trees.fixture(spark, "river")


query("topological_order_river", f"WITH RECURSIVE {_levels_sql(_RIVER)} SELECT * FROM ordered")(lambda spark, _: dag.topological_order(_river(spark)))
query("topological_order_reversed", f"WITH RECURSIVE {_levels_sql(f'(SELECT ord, parent AS child, child AS parent FROM {_RIVER} AS y)')} SELECT * FROM ordered")(lambda spark, _: dag.topological_order(dag.reversed_edges(_river(spark))))
query("topological_order_replay", f"WITH RECURSIVE {_levels_sql(_REPLAY)} SELECT * FROM ordered")(lambda spark, d: dag.topological_order(trees.replay_tree(table(spark, d, "orders"))))
query("topological_chunks", f"WITH RECURSIVE {_levels_sql(_REPLAY)} SELECT node, rank, least(rank // CAST(ceil(n / 7) AS BIGINT), 6)::BIGINT AS cluster_id FROM {_COUNTED}")(lambda spark, d: dag.topological_chunks(trees.replay_tree(table(spark, d, "orders")), 7))
_EVEN_RIVER = f"WITH RECURSIVE {_levels_sql(_RIVER)}, a AS (SELECT node, rank, ({_EVEN.format(k=4)})::BIGINT AS cluster_id FROM {_COUNTED})"
query("topological_even", _EVEN_RIVER + " SELECT * FROM a")(lambda spark, _: dag.topological_even(_river(spark), 4))
_QUOT = ", q AS (SELECT x.cluster_id AS from_cluster, y.cluster_id AS to_cluster FROM e JOIN a x ON x.node = parent JOIN a y ON y.node = child WHERE x.cluster_id <> y.cluster_id)"
query("cluster_quotient", _EVEN_RIVER + _QUOT + " SELECT *, count(*) AS edges FROM q GROUP BY ALL")(lambda spark, _: dag.quotient(_river(spark), dag.topological_even(_river(spark), 4)))
query("dependency_violations", _EVEN_RIVER + _QUOT + " SELECT count(*) AS violations FROM q WHERE to_cluster < from_cluster")(lambda spark, _: dag.violations(_river(spark), dag.topological_even(_river(spark), 4)))
query("cluster_cycle", _EVEN_RIVER + _QUOT + ", r AS (SELECT from_cluster AS f, to_cluster AS t FROM q UNION SELECT r.f, q.to_cluster FROM r JOIN q ON r.t = q.from_cluster) SELECT count(*) FILTER (f = t) > 0 AS cyclic FROM r")(
    lambda spark, _: spark.createDataFrame([(dag.clusters_cyclic(_river(spark), dag.topological_even(_river(spark), 4)),)], "cyclic boolean")
)
query(
    "cluster_size_report",
    _EVEN_RIVER + """, n AS (SELECT cluster_id, count(*) AS size FROM a GROUP BY 1), m AS (SELECT avg(size) AS mean_size, median(size) AS median_size, stddev_pop(size) AS stddev_size FROM n)
SELECT cluster_id, size, mean_size, median_size, round(stddev_size, 6) AS stddev_size, round((size - median_size) * 100 / median_size, 6) AS deviation_pct, (size - median_size) * 100 / median_size > 150 AS oversized FROM n, m""",
)(lambda spark, _: dag.cluster_report(dag.topological_even(_river(spark), 4)).withColumns({"stddev_size": F.round("stddev_size", 6), "deviation_pct": F.round("deviation_pct", 6)}))


def _tree_sql(edges: str) -> str:
    """The tree below the smallest root, its longest path, and the subtrees off it."""
    return f"""e AS (SELECT * FROM {edges} AS x), top AS (SELECT min(parent) AS root FROM e WHERE parent NOT IN (SELECT child FROM e)),
t AS (
  SELECT root::BIGINT AS node, NULL::BIGINT AS parent, NULL::BIGINT AS ord, 0 AS depth, [root::BIGINT] AS path, []::BIGINT[] AS key FROM top
  UNION ALL SELECT e.child::BIGINT, e.parent::BIGINT, e.ord::BIGINT, depth + 1, list_append(path, e.child::BIGINT), list_append(key, e.ord::BIGINT) FROM t JOIN e ON e.parent = t.node
), lp AS (SELECT path AS lp FROM t WHERE depth = (SELECT max(depth) FROM t) ORDER BY path LIMIT 1),
off AS (SELECT node, key, len(list_filter(path, lambda v: list_contains(lp, v))) AS common, path FROM t, lp WHERE NOT list_contains(lp, node)),
hang AS (SELECT node, path[common + 1] AS subtree, (common - 1)::INT AS spot, key[common] AS root_ord FROM off),
sizes AS (SELECT subtree, spot, root_ord, count(*) AS size FROM hang GROUP BY ALL)"""


_TREES = {"a": trees.values_sql("tree_a"), "b": trees.values_sql("tree_b"), "replay": _REPLAY}


def _edges(spark: SparkSession, d: str, which: str) -> DataFrame:
    return trees.replay_tree(table(spark, d, "orders")) if which == "replay" else trees.fixture(spark, f"tree_{which}")


for _w, _edge_sql in _TREES.items():
    _with = f"WITH RECURSIVE {_tree_sql(_edge_sql)} "
    query(f"tree_{_w}", _with + "SELECT node, parent, depth, path FROM t", "path")(lambda spark, d, w=_w: dag.tree(_edges(spark, d, w)).select("node", "parent", "depth", "path"))
    query(f"longest_path_{_w}", _with + "SELECT unnest(lp) AS node, unnest(range(len(lp))) AS pos FROM lp")(
        lambda spark, d, w=_w: spark.createDataFrame([(int(n), p) for p, n in enumerate(dag.longest_path(dag.tree(_edges(spark, d, w))))], "node bigint, pos bigint")
    )
    query(f"longest_paths_{_w}", _with + "SELECT path FROM t WHERE depth = (SELECT max(depth) FROM t)", "path")(lambda spark, d, w=_w: dag.longest_paths(dag.tree(_edges(spark, d, w))))

    def _hanging(spark, d, w=_w):
        t = dag.cut(dag.tree(_edges(spark, d, w)))
        return dag.hanging_subtrees(t, dag.longest_path(t))

    query(f"subtrees_{_w}", _with + "SELECT node, subtree, spot, root_ord FROM hang")(lambda spark, d, h=_hanging: h(spark, d).select("node", "subtree", "spot", "root_ord"))
    query(f"subtree_sizes_{_w}", _with + ", m AS (SELECT avg(size) AS mean, median(size) AS med FROM sizes) SELECT subtree, spot, root_ord, size, round(mean, 6) AS mean_size, med AS median_size, round((size - med) * 100 / med, 6) AS deviation_pct, abs((size - med) * 100 / med) > 150 AS oversized FROM sizes, m")(
        lambda spark, d, h=_hanging: dag.size_report(dag.subtree_sizes(h(spark, d))).withColumns({"mean_size": F.round("mean_size", 6), "deviation_pct": F.round("deviation_pct", 6)})
    )
    query(f"partition_longest_path_{_w}")(lambda spark, d, w=_w: dag.partition_longest_path(_edges(spark, d, w), 8))
    query(f"partition_critical_path_{_w}")(lambda spark, d, w=_w: dag.partition_critical_path(_edges(spark, d, w), 5))
query("critical_segments", f"WITH RECURSIVE {_tree_sql(_TREES['b'])}, p AS (SELECT unnest(lp) AS node, unnest(range(len(lp))) AS pos FROM lp) SELECT node, ntile(least(5 // 2, (SELECT len(lp) FROM lp) // 3)::BIGINT) OVER (ORDER BY pos) - 1 AS segment FROM p")(
    lambda spark, d: (lambda p: spark.createDataFrame([(int(n), s) for s, (a, b) in enumerate(dag.segments(len(p), 5)) for n in p[a:b]], "node bigint, segment bigint"))(dag.longest_path(dag.tree(_edges(spark, d, "b"))))
)
query("connected_nodes", f"WITH e AS (SELECT * FROM {_RIVER} AS x), n AS (SELECT parent AS v FROM e UNION SELECT child FROM e) SELECT a.v AS a, b.v AS b, EXISTS (SELECT 1 FROM e WHERE (parent = a.v AND child = b.v) OR (parent = b.v AND child = a.v)) OR EXISTS (SELECT 1 FROM e x JOIN e y ON x.child = y.child WHERE x.parent = a.v AND y.parent = b.v) AS connected FROM n a JOIN n b ON a.v < b.v")(
    lambda spark, _: (lambda n: dag.connected(_river(spark), n.withColumnRenamed("node", "a").join(n.withColumnRenamed("node", "b"), F.col("a") < F.col("b"))))(dag.nodes(_river(spark)))
)
query("best_cluster")(lambda spark, _: (lambda a: dag.best_cluster(_river(spark), a.where("rank % 5 <> 0"), a.where("rank % 5 = 0").select("node")))(dag.cut(dag.topological_even(_river(spark), 4))))
query("cluster_levels")(lambda spark, _: (lambda e: spark.createDataFrame(sorted(dag.cluster_levels(e, dag.partition_longest_path(e, 8), dag.longest_path(dag.tree(e))).items()), "cluster_id bigint, level int"))(trees.fixture(spark, "tree_b")))
query("geo_tree_depths", f"WITH RECURSIVE e AS ({_GEO}), t AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM t JOIN e ON parent = node) SELECT depth, count(*) AS nodes FROM t GROUP BY depth")(lambda spark, d: dag.tree(_geo(spark, d), 0).groupBy("depth").agg(F.count("*").alias("nodes")))
query("dot_text", f"SELECT * FROM (SELECT -2 AS ord, 'digraph G {{' AS line UNION ALL SELECT ord, '  ' || parent || ' -> ' || child || ';' FROM {_RIVER} AS x UNION ALL SELECT max(ord) + 1, '}}' FROM {_RIVER} AS x)")(lambda spark, _: dag.dot_lines(_river(spark)))


# ---- points ----------------------------------------------------------------------------------------------------------


def customer_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))


def _first(df: DataFrame, k: int) -> list[tuple[float, float]]:
    return [(r["x"], r["y"]) for r in df.orderBy("point_id").limit(k).collect()]


_CUST = "SELECT c_custkey AS point_id, c_acctbal AS x, c_custkey::DOUBLE AS y FROM customer"
query("points_kmeans_customer", lloyd_sql(f"SELECT row_number() OVER (ORDER BY point_id) - 1 AS k, x, y FROM ({_CUST} ORDER BY point_id LIMIT 8) AS f", _CUST, ("x", "y"), 20, False, "point_id") + "SELECT point_id, k::BIGINT AS cluster_id FROM assigned")(
    lambda spark, d: (lambda p: grid_centres.lloyd(p, ["x", "y"], _first(p, 8), 20)[0].select("point_id", "cluster_id"))(customer_points(spark, d))
)
query("points_kmeans_plus_plus")(lambda spark, d: points.kmeans(customer_points(spark, d), 8))
_EMB = "SELECT vec_id AS point_id, vec[1]::DOUBLE AS x, vec[2]::DOUBLE AS y FROM embeddings"


def embedding_points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    vector = next(f.name for f in e.schema.fields if f.dataType.typeName() == "array")
    return e.select(F.col("vec_id").alias("point_id"), F.get(vector, F.lit(0)).cast("double").alias("x"), F.get(vector, F.lit(1)).cast("double").alias("y"))


query("points_kmeans_embeddings")(lambda spark, d: points.kmeans(embedding_points(spark, d), 10))
query("points_sweep")(lambda spark, _: points.sweep(point_sets.dataset(spark, "three_blobs")))
query("points_centroids")(lambda spark, _: points.centroids(points.hue(points.kmeans(point_sets.dataset(spark, "heart_shape"), 4), 4)))
query("features_kmeans")(lambda spark, d: (lambda e, v: graph.kmeans_features(ranked(e.select("vec_id", F.col(v).cast("array<double>").alias("features")), [F.col("vec_id")], "id").select("id", "features"), 10, e.count()))(table(spark, d, "embeddings"), next(f.name for f in table(spark, d, "embeddings").schema.fields if f.dataType.typeName() == "array")))


# ---- sinks -----------------------------------------------------------------------------------------------------------

query("cluster_colours", f"SELECT {_NAMES}, cluster_id, abs(cluster_id % 45) AS color_index FROM ({_grid_sql('honeycomb')}) AS h(i, j, cell_id, cluster_id)")(lambda spark, _: sinks.colour_index(registry.partition_grid(spark, ROWS, COLS, K, "honeycomb")))
query("cluster_picture")(lambda spark, _: sinks.picture_lines(registry.partition_grid(spark, ROWS, COLS, K, "honeycomb")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Four partitioners of the grid of events, their statistics, the spread of weights, and the ranking."""
    cells, union = event_grid(spark, d), None
    for m in ("horizontal", "grid", "bsp", "diagonal"):
        one = registry.with_adjacent(spark, EVENT_ROWS, EVENT_COLS, K, m)
        union = one if union is None else union.unionByName(one)
    loads = union.join(cells.select("cell_id", "weight"), "cell_id").groupBy("method", "cluster_id").agg(F.sum("weight").alias("w")).groupBy("method").agg(F.min("w").alias("min_weight"), F.max("w").alias("max_weight"))
    return measures.ranking(measures.statistics(union)).join(loads, "method").select("rank", "method", "clusters", "min_size", "max_size", "avg_size", "stddev_size", "cv", "border_cells", "border_pct", "min_weight", "max_weight")


def _flagship_sql() -> str:
    of = lambda m: f"SELECT '{m}' AS method, {_NAMES}, cast({FORMS[m](DUCK, EVENT_ROWS, EVENT_COLS, K, 'i', 'j')} as bigint) AS cluster_id FROM {grids.cells_sql(DUCK, EVENT_ROWS, EVENT_COLS)} AS g"
    union = " UNION ALL ".join(of(m) for m in ("horizontal", "grid", "bsp", "diagonal"))
    return f"""WITH cells AS ({union}), {measures.ADJACENT_SQL}, {measures.STATS_SQL}, ranked AS ({_RANK}),
w AS (SELECT method, cluster_id, sum(weight)::BIGINT AS w FROM cells JOIN {_EVENTS} AS e USING (cell_id) GROUP BY ALL),
l AS (SELECT method, min(w) AS min_weight, max(w) AS max_weight FROM w GROUP BY 1)
SELECT rank, method, clusters, min_size, max_size, avg_size, stddev_size, cv, border_cells, border_pct, min_weight, max_weight FROM ranked JOIN l USING (method)"""


query("flagship", _flagship_sql())(flagship)
