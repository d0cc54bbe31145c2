"""Grid partitioners: golden statistics, and properties of those that SQL can't express."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import agents, grid_walks, measures, soil
from cellweave.plans import registry
from cellweave.sources import grids

#: method: clusters, min, max, deviation, variation, border cells at 100 x 100 cells and 8 clusters.
GOLDEN = {
    "sierpinski": (3, 1875, 5625, 1640.4183, 0.492125, 587),
    "phyllotaxis": (8, 895, 1929, 319.5450, 0.255636, 689),
    "triangular": (8, 1225, 1275, 24.7538, 0.019803, 784),
    "fractal": (8, 1250, 1250, 0, 0, 788),
    "grid": (8, 1250, 1250, 0, 0, 788),
    "bsp": (8, 1250, 1250, 0, 0, 788),
    "diagonal": (8, 300, 2200, 698.8830, 0.559106, 799),
    "mosaic": (7, 2, 3444, 1123.7300, 0.786611, 1045),
    "honeycomb": (8, 1100, 1422, 95.8606, 0.076688, 1072),
    "checkerboard": (8, 1089, 2178, 351.6824, 0.281346, 1164),
    "horizontal": (8, 900, 1300, 132.2876, 0.105830, 1400),
    "vertical": (8, 900, 1300, 132.2876, 0.105830, 1400),
    "rotating_squares": (8, 737, 1976, 410.5862, 0.328469, 1857),
    "circular": (8, 241, 2402, 761.1069, 0.608886, 1908),
    "concentric": (8, 241, 2402, 761.1069, 0.608886, 1908),
    "mandelbrot": (8, 127, 3919, 1217.9313, 0.974345, 2008),
    "cross": (8, 732, 3364, 810.2913, 0.648233, 2470),
    "spiral": (8, 1250, 1250, 0, 0, 3788),
    "wave": (8, 845, 1931, 410.6315, 0.328505, 5821),
}


def test_golden_statistics(spark):
    got = {r.method: r for r in registry.rank(spark, 100, 100, 8, tuple(GOLDEN)).collect()}
    for m, (n, low, high, deviation, cv, border) in GOLDEN.items():
        r = got[m]
        assert (r.clusters, r.min_size, r.max_size, r.border_cells) == (n, low, high, border), m
        assert r.stddev_size == pytest.approx(deviation, abs=1e-4) and r.cv == pytest.approx(cv, abs=1e-6), m
    assert got["sierpinski"].rank == 1 and got["wave"].rank == len(GOLDEN)


def test_strips_can_be_fewer(spark):
    assert registry.partition_grid(spark, 10, 4, 6, "horizontal").select("cluster_id").distinct().count() == 5


@pytest.mark.parametrize("method", ["grid", "honeycomb", "minimal_border"])
@pytest.mark.parametrize("neighbours", [4, 8])
def test_borders_by_expression_equal_borders_by_windows(spark, method, neighbours):
    a = registry.with_adjacent(spark, 30, 20, 5, method, neighbours)
    b = measures.with_adjacent(registry.partition_grid(spark, 30, 20, 5, method).select(F.lit(method).alias("method"), "*"), neighbours == 8)
    assert sorted(map(str, a.select("cell_id", "adjacent").collect())) == sorted(map(str, b.select("cell_id", "adjacent").collect()))


@pytest.mark.parametrize("method", [m for m in registry.METHODS if m != "recursive_h"])
def test_every_cell_is_assigned_once(spark, method):
    got = registry.partition_grid(spark, 12, 9, 4, method).collect()
    assert sorted(r.cell_id for r in got) == list(range(108))
    assert all(r.cell_id == r.row * 9 + r.col and r.cluster_id is not None and r.cluster_id >= 0 for r in got)


def test_balanced_growth(spark):
    sizes = [r["count"] for r in registry.partition_grid(spark, 20, 20, 8, "voronoi").groupBy("cluster_id").count().collect()]
    assert sizes == [50] * 8


def test_fill_nearest(spark):
    cells = grids.cells(spark, 7, 9).withColumn("cluster_id", F.when(F.col("cell_id") == 10, 3).when(F.col("cell_id") == 50, 1).cast("bigint"))
    seeds = [(3, 1, 1), (1, 5, 5)]
    got = {(r.row, r.col): r.cluster_id for r in grid_walks.fill_nearest(cells).collect()}
    for (r, c), k in got.items():
        assert k == min((abs(r - a) + abs(c - b), n) for n, a, b in seeds)[1]


def test_public_calls(spark):
    lists = registry.public(spark, "grid_horizontal_partitioning", 4, 3, 2).orderBy("cluster_id").collect()
    assert [list(r.members) for r in lists] == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]]
    assert registry.grid_partitioning(spark, [[0] * 4] * 4, 2).count() == 2 and registry.grid_partitioning(spark, (4, 4), 2).count() == 2
    with pytest.raises(ValueError):
        registry.partition_grid(spark, 0, 3, 2, "grid")
    with pytest.raises(ValueError):
        registry.with_adjacent(spark, 3, 3, 2, "grid", 5)


def test_mask_is_checked(spark):
    mask = grids.cells(spark, 3, 3).withColumn("is_agent", F.lit(True))
    assert grids.checked_mask(mask, 3, 3).count() == 9
    with pytest.raises(ValueError):
        grids.checked_mask(mask, 3, 4)


def test_agents_are_balanced_and_refined(spark):
    mask = spark.sql(grids.random_mask_sql(grids.SPARK, 16, 16, 0.4)).withColumnRenamed("cell_id", "cell_id")
    n = mask.where("is_agent").count()
    for way in (agents.partition_agents, agents.partition_agents_frontier):
        got = way(mask, 16, 16, 4, rounds=0)
        sizes = [r["count"] for r in got.groupBy("cluster_id").count().collect()]
        assert sum(sizes) == n and len(sizes) == 4 and max(sizes) - min(sizes) <= 1
        moved = way(mask, 16, 16, 4, rounds=9)
        assert moved.count() == n and moved.select("cluster_id").distinct().count() == 4


def test_weighted_refinement_keeps_cells(spark):
    cells = grids.weights(spark, "gradient", 12, 12)
    got = agents.partition_weighted(cells, 12, 12, 4, rounds=9)
    assert got.count() == 144 and got.select("cluster_id").distinct().count() == 4


def plain_refine(cells, k, passes, frontier=0.0, spatial=3.0, least=0.0, weights=None):
    """cells: {(row, col): cluster or None}; refinement cell by cell in plain Python."""
    at, w = dict(cells), weights or dict.fromkeys(cells, 1)
    load, count = {}, {}
    for p, c in at.items():
        if c is not None:
            load[c], count[c] = load.get(c, 0) + w[p], count.get(c, 0) + 1
    mean = sum(load.values()) // k

    def best(p):
        r, c = p
        own = at[p]
        beside = [at.get(q) for q in ((r, c - 1), (r, c + 1), (r - 1, c), (r + 1, c)) if at.get(q) is not None]
        around = [at.get((r + a, c + b)) for a in range(-2, 3) for b in range(-2, 3) if (a or b) and at.get((r + a, c + b)) is not None]
        like = lambda x: beside.count(x) / len(beside)
        near = lambda x: around.count(x) / len(around)
        out = []
        for x in set(beside) - {own}:
            if weights:
                off = lambda v: abs(v - mean)
                g = spatial * near(x) + off(load[own]) + off(load[x]) - off(load[own] - w[p]) - off(load[x] + w[p])
            else:
                g = frontier * (like(x) - like(own)) + spatial * (near(x) - near(own)) + (load[own] - load[x] > 2) - (load[own] - load[x] < -2)
            out.append((g, -x))
        return max(out, default=None)

    for _ in range(passes):
        moves = 0
        for n in range(9):
            mine = [(p, best(p)) for p in at if at[p] is not None and (p[0] % 3, p[1] % 3) == (n % 3, n // 3)]
            for p, _b in sorted((m for m in mine if m[1]), key=lambda m: (-m[1][0], -m[1][1], m[0])):
                g, x = best(p)
                if g > least and count[at[p]] > 1:
                    for c, sign in ((at[p], -1), (-x, 1)):
                        load[c] += sign * w[p]
                        count[c] += sign
                    at[p], moves = -x, moves + 1
        if not moves:
            break
    return at


def test_refinement_runs_all_passes(spark):
    """Default limits, against plain Python, which does not skip circles."""
    size = 9
    cells = grids.weights(spark, "gradient", size, size).withColumn("weight", F.col("cell_id") % 7 + F.col("row"))
    start = agents.seeded(cells, size, size, 4).collect()
    got = {(r.row, r.col): r.cluster_id for r in agents.partition_weighted(cells, size, size, 4).collect()}
    assert got == plain_refine({(r.row, r.col): r.cluster_id for r in start}, 4, 100, weights={(r.row, r.col): r.weight for r in start})

    mask = spark.sql(grids.random_mask_sql(grids.SPARK, 14, 14, 0.6))
    none = {(r.row, r.col): None for r in mask.collect()}
    for way, passes, *gains in ((agents.partition_agents, 50, 0.0, 1.0, 0.1), (agents.partition_agents_frontier, 200, 5.0, 3.0, 0.05)):
        begun = none | {(r.row, r.col): r.cluster_id for r in way(mask, 14, 14, 4, rounds=0).collect()}
        want = plain_refine(begun, 4, passes, *gains)
        assert {(r.row, r.col): r.cluster_id for r in way(mask, 14, 14, 4).collect()} == {p: c for p, c in want.items() if c is not None}


def test_soil(spark):
    cells = spark.createDataFrame([(0, 0, 0, "PORE"), (0, 1, 1, "MINERAL"), (0, 2, 2, "PORE"), (1, 0, 3, "PORE"), (1, 1, 4, "PORE"), (1, 2, 5, "PORE")], "row int, col int, cell_id bigint, cell_type string")
    fixed = cells.withColumn("cluster_id", F.expr("CASE cell_id WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 1 END").cast("bigint"))
    assert [(r.cell_id, list(r.adjacent)) for r in soil.border_cells(fixed).collect()] == [(1, [0, 1])]
    assert sorted((r.cell_id, r.cluster_id, r.other) for r in soil.adjacent_pores(fixed).collect()) == [(4, 0, 1), (5, 1, 0)]
    made = soil.pore_clusters(cells, 2)
    assert made.where("cell_type = 'PORE' AND cluster_id IS NULL").count() == 0 and made.where("cell_type <> 'PORE' AND cluster_id IS NOT NULL").count() == 0
    assert soil.pore_clusters(cells.where("cell_type = 'MINERAL'"), 2).where("cluster_id IS NOT NULL").count() == 0


def test_weights(spark):
    lows = {n: grids.weights(spark, n, 20, 30).agg(F.min("weight"), F.max("weight"), F.count("*")).first() for n in grids.ALL_WEIGHTS}
    assert all(r[2] == 600 and 0 <= r[0] <= r[1] <= 255 for r in lows.values())
    assert tuple(lows["power_law"])[:2] == (255, 255) and tuple(lows["sparse_peaks"])[:2] == (10, 255)


def test_gated_refinement(spark):
    mask = spark.sql(grids.random_mask_sql(grids.SPARK, 12, 12, 0.7))
    dense = mask.select("row", "col", "cell_id", F.expr("CASE WHEN is_agent THEN cast(CASE WHEN row = 0 AND col < 6 THEN 1 ELSE 0 END as bigint) END").alias("cluster_id"))
    sizes = lambda df: {r["cluster_id"]: r["count"] for r in df.where("cluster_id IS NOT NULL").groupBy("cluster_id").count().collect()}
    before, after = sizes(dense), sizes(agents.refine(dense, 2, 90, 0.0, 1.0, 0.1, None, gate=1))
    # Cells only leave the larger cluster, and none moves once the counts are within one.
    assert sum(after.values()) == sum(before.values()) and before[1] <= after[1] <= after[0] + 1
    even = agents.partition_agents(mask, 12, 12, 4, rounds=0)
    gated = agents.partition_agents(mask, 12, 12, 4, gate=1)
    assert sorted(map(tuple, even.select("cell_id", "cluster_id").collect())) == sorted(map(tuple, gated.select("cell_id", "cluster_id").collect()))


def test_nematodes_stand_on_drawn_pores(spark):
    soil_cells = spark.sql(grids.soil_sql(grids.SPARK, 12, 15))
    want = spark.sql(grids.nematodes_sql(grids.SPARK, grids.soil_sql(grids.SPARK, 12, 15), 20)).collect()
    assert sorted(map(tuple, grids.nematodes(soil_cells, 20).collect())) == sorted(map(tuple, want))
    assert grids.nematodes(soil_cells.where("cell_type <> 'PORE'"), 5).count() == 0
