"""Weighted grids and agents on grids: balanced partitioning, refinement and measures."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import cut
from .grid_centres import euclid, nearest



def lattice(rows: int, cols: int, k: int) -> list[tuple[int, int]]:
    """Seeds at a spacing of rows and columns over floor(sqrt(k)), k at most."""
    down, across = max(1, rows // math.isqrt(k)), max(1, cols // math.isqrt(k))
    return [(r, c) for r in range(down // 2, rows, down) for c in range(across // 2, cols, across)][:k]


def seeded(cells: DataFrame, rows: int, cols: int, k: int) -> DataFrame:
    """cells with the nearest lattice seed. A cell's weight scales all its distances alike, so it doesn't decide."""
    return cells.withColumn("cluster_id", nearest(euclid(F.col("row"), F.col("col")), lattice(rows, cols, k), "rc"))


def surroundings(cells: DataFrame) -> DataFrame:
    """cells (dense; cluster_id null where there is none) with ``around`` (the clusters in the 5 x 5 window, itself included) and ``beside`` (those of the four neighbours)."""
    across = W.partitionBy("row").orderBy("col")
    line = cells.withColumns({
        "_line": F.collect_list("cluster_id").over(across.rangeBetween(-2, 2)),
        "_w": F.lag("cluster_id").over(across),
        "_e": F.lead("cluster_id").over(across),
    })
    down = W.partitionBy("col").orderBy("row")
    both = line.withColumns({
        "around": F.flatten(F.collect_list("_line").over(down.rangeBetween(-2, 2))),
        "beside": F.array_compact(F.array(F.col("_w"), F.col("_e"), F.lag("cluster_id").over(down), F.lead("cluster_id").over(down))),
    })
    return both.drop("_line", "_w", "_e")


def share_of(array: Column, cluster: Column, less: Column | int = 0) -> Column:
    """The share of an array's entries in a cluster, without the cell itself (its own cluster is ``less`` of them)."""
    n = F.size(array) - 1
    return F.when(n > 0, (F.size(F.filter(array, lambda x: x == cluster)) - less) / n).otherwise(F.lit(0.0))


def coherence(cells: DataFrame) -> DataFrame:
    """cells with ``coherence``: the share of the up to 24 cells around that are in the same cluster."""
    return surroundings(cells).withColumn("coherence", share_of(F.col("around"), F.col("cluster_id"), 1)).drop("around", "beside")


def refine(cells: DataFrame, k: int, rounds: int = 900, frontier: float = 0.0, spatial: float = 3.0, least: float = 0.0, weight: str | None = "weight", gate: int | None = None) -> DataFrame:
    """Move cells to clusters beside them while that helps; nine rounds are a pass over all cells, and a pass without a move ends it.

    Rounds take the cells of one colour of ``(row % 3, col % 3)``, so no two
    moving cells see each other; only loads tie them.  The driver gets the
    round's cells at borders and makes all moves that help, the best first,
    with exact loads.  The gain is ``spatial`` times the new coherence (for
    agents the change of it) plus ``frontier`` times the change of the share of
    like neighbours, plus the balance: for weights the fall of both clusters'
    distance from the mean; for agents (``weight`` None) 1 if counts differ by
    over 2 the right way, -1 the wrong way.  With a ``gate`` a cell only moves
    to a cluster that is smaller than its own by more than the gate, and the
    balance adds nothing.  A cluster is never emptied.

    Such gains can run in circles.  A pass follows from the assignment alone, so
    once one returns (a 128-bit digest tells), whole circles are skipped: the
    result is that of all ``rounds``.
    """
    base = cut(cells)
    spark, own = base.sparkSession, F.col("cluster_id")
    value = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1)
    loads, counts = {}, {}
    for r in base.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.sum(value).alias("w"), F.count("*").alias("n")).collect():
        loads[r["cluster_id"]], counts[r["cluster_id"]] = r["w"], r["n"]
    mean = sum(loads.values()) // max(1, k)

    def fixed(new: Column) -> Column:
        if weight:
            return spatial * share_of(F.col("around"), new)
        like = lambda c: F.when(F.size("beside") > 0, F.size(F.filter("beside", lambda x: x == c)) / F.size("beside")).otherwise(F.lit(0.0))
        return frontier * (like(new) - like(own)) + spatial * (share_of(F.col("around"), new) - share_of(F.col("around"), own, 1))

    def balance(old, new, w) -> float:
        if weight:
            return abs(loads[old] - mean) + abs(loads[new] - mean) - abs(loads[old] - w - mean) - abs(loads[new] + w - mean)
        differ = loads[old] - loads[new]
        if gate is not None:
            return 0 if differ > gate else -math.inf
        return (differ > 2) - (differ < -2)

    def best(r):
        return max((o["gain"] + balance(r["from"], o["to"], r["w"]), -o["to"]) for o in r["options"])

    options = F.transform(F.array_except(F.array_distinct("beside"), F.array(own)), lambda c: F.struct(c.alias("to"), fixed(c).alias("gain")))
    digest_of = lambda row, col, c: int.from_bytes(hashlib.md5(f"{row},{col},{c}".encode()).digest())
    state, moved, quiet, n, digest, met = base, [], 0, 0, 0, {0: 0}
    while n < rounds:
        colour = (F.col("row") % 3 == n % 3) & (F.col("col") % 3 == n // 3 % 3) & own.isNotNull()
        seen = surroundings(state).where(colour).select("row", "col", own.alias("from"), value.alias("w"), options.alias("options")).where(F.size("options") > 0)
        before = len(moved)
        for r in sorted(seen.collect(), key=lambda r: (*(-x for x in best(r)), r["row"], r["col"])):
            gain, to = best(r)
            if gain > least and counts[r["from"]] > 1:
                for c, sign in ((r["from"], -1), (-to, 1)):
                    loads[c] += sign * r["w"]
                    counts[c] += sign
                moved.append((r["row"], r["col"], -to))
                digest ^= digest_of(r["row"], r["col"], r["from"]) ^ digest_of(r["row"], r["col"], -to)
        quiet = 0 if len(moved) > before else quiet + 1
        if quiet == 9:
            break
        if len(moved) > before:
            change = spark.createDataFrame(moved, "row int, col int, _to bigint")
            state = base.join(F.broadcast(change), ["row", "col"], "left").withColumn("cluster_id", F.coalesce("_to", "cluster_id")).select(*cells.columns)
        if n % 9 == 8 and moved:
            base = state = cut(state)
            moved = []
        n += 1
        if n % 9 == 0:
            circle = n - met.setdefault(digest, n)
            if circle:
                n += (rounds - n) // circle * circle
                met = {}
    return state


def partition_weighted(cells: DataFrame, rows: int, cols: int, k: int, rounds: int = 900) -> DataFrame:
    """(row, col, cell_id, weight, cluster_id)."""
    return refine(seeded(cells, rows, cols, k), k, rounds)


def fill_to_capacity(points: DataFrame, seeds: list[tuple[int, int]], sizes: list[int]) -> DataFrame:
    """points (row, col, cell_id) with ``cluster_id``: every point goes to the nearest seed that has room, the closest first.

    Rounds: each point left proposes to its nearest seed with room (ties to the
    lowest), which takes the closest up to its room; so each round fills a
    cluster or ends.  Points beyond all room get the nearest seed.
    """
    left, done, room = cut(points), None, list(sizes)
    while True:
        open_seeds = [(r, c, n) for n, (r, c) in enumerate(seeds) if room[n] > 0]
        if not open_seeds:
            break
        literal = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(n).alias("k")) for r, c, n in open_seeds])
        best = F.array_min(F.transform(literal, lambda s: F.struct(euclid(F.col("row"), F.col("col"))(s).alias("d"), s["k"].alias("k"))))
        offered = left.withColumn("_b", best)
        place = F.row_number().over(W.partitionBy("_b.k").orderBy("_b.d", "cell_id"))
        limits = F.element_at(F.array(*map(F.lit, room)), F.col("_b.k") + 1)
        taken = cut(offered.withColumn("_take", place <= limits).withColumn("cluster_id", F.col("_b.k").cast("bigint")).drop("_b"))
        new = taken.where("_take").drop("_take")
        done = new if done is None else done.unionByName(new)
        left = taken.where("NOT _take").drop("_take", "cluster_id")
        for r in new.groupBy("cluster_id").count().collect():
            room[r["cluster_id"]] -= r["count"]
        if left.isEmpty():
            return done
    rest = left.withColumn("cluster_id", nearest(euclid(F.col("row"), F.col("col")), seeds, "rc"))
    return rest if done is None else done.unionByName(rest)


def _even(n: int, k: int) -> list[int]:
    return [n // k + (c < n % k) for c in range(k)]


def nearest_points(points: DataFrame, targets: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """For each target in turn the nearest point that is still free."""
    out: list[tuple[int, int]] = []
    for r, c in targets:
        free = points.where(~F.struct("row", "col").isin([F.struct(F.lit(a), F.lit(b)) for a, b in out])) if out else points
        d = (F.col("row") - r) * (F.col("row") - r) + (F.col("col") - c) * (F.col("col") - c)
        got = free.agg(F.min_by(F.struct("row", "col"), F.struct(d, "cell_id")).alias("x")).first()["x"]
        if got is None:
            break
        out.append((got["row"], got["col"]))
    return out


def partition_agents(mask: DataFrame, rows: int, cols: int, k: int, rounds: int = 450, gate: int | None = None) -> DataFrame:
    """(row, col, cell_id, cluster_id) of the agents: seeds near lattice points, sizes that differ by one at most, then refinement.

    The lattice has ceil(sqrt(k)) points a side, of which the first k count, so
    there are k seeds for every k.  With ``gate=1`` cells only move to clusters
    that are smaller by over one.
    """
    agents = cut(mask.where("is_agent").select("row", "col", "cell_id"))
    side = math.ceil(math.sqrt(k))
    down, across = max(1, rows // side), max(1, cols // side)
    targets = [(r, c) for r in range(down // 2, rows, down) for c in range(across // 2, cols, across)][:k]
    return _partitioned(mask, agents, targets, k, rounds, 0.0, 1.0, 0.1, gate)


def region_centres(rows: int, cols: int, k: int) -> list[tuple[int, int]]:
    """Centres of the first k regions after all were halved along their longer sides (upright on ties) until there are k."""
    boxes = [(0, 0, rows, cols)]
    while len(boxes) < k:
        new = []
        for t, left, b, r in boxes:
            if r - left >= b - t:
                mid = (left + r) // 2
                new += [(t, left, b, mid), (t, mid, b, r)]
            else:
                mid = (t + b) // 2
                new += [(t, left, mid, r), (mid, left, b, r)]
        if len(new) == len(boxes) or all(b - t < 1 or r - left < 1 for t, left, b, r in new):
            break
        boxes = new
    return [((t + b) // 2, (left + r) // 2) for t, left, b, r in boxes[:k]]


def partition_agents_frontier(mask: DataFrame, rows: int, cols: int, k: int, rounds: int = 1800) -> DataFrame:
    """Like ``partition_agents``, from seeds in halved regions, and refined with weight on short frontiers."""
    agents = cut(mask.where("is_agent").select("row", "col", "cell_id"))
    return _partitioned(mask, agents, region_centres(rows, cols, k), k, rounds, 5.0, 3.0, 0.05)


def _partitioned(mask, agents, targets, k, rounds, frontier, spatial, least, gate=None) -> DataFrame:
    n = agents.count()
    seeds = nearest_points(agents, targets)
    if not seeds:
        return agents.withColumn("cluster_id", F.lit(None).cast("bigint"))
    out = fill_to_capacity(agents, seeds, _even(n, len(seeds)))
    if rounds:
        dense = mask.select("row", "col", "cell_id").join(out.select("cell_id", "cluster_id"), "cell_id", "left").select("row", "col", "cell_id", "cluster_id")
        out = refine(dense, k, rounds, frontier, spatial, least, None, gate).where("cluster_id IS NOT NULL")
    return out


def cluster_weights(cells: DataFrame) -> DataFrame:
    return cells.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.sum("weight").alias("weight"), F.count("*").alias("cells"))


def cluster_distribution(cells: DataFrame) -> DataFrame:
    by = cluster_weights(cells)
    total = by.agg(F.sum("weight").alias("_total"))
    return by.crossJoin(F.broadcast(total)).select("cluster_id", "weight", "cells", F.round(F.col("weight") / F.col("_total"), 6).alias("share"))


def cluster_metrics(cells: DataFrame, k: int) -> DataFrame:
    """One row: avg_weight (whole, over k), max_weight_deviation from it, avg_connectivity (clusters among a cell's neighbours, its own included)."""
    weights = cluster_weights(cells)
    total = weights.agg(F.expr(f"sum(weight) div {k}").alias("avg_weight"))
    away = weights.crossJoin(F.broadcast(total)).agg(F.first("avg_weight").alias("avg_weight"), F.max(F.abs(F.col("weight") - F.col("avg_weight")) / F.col("avg_weight")).alias("d"))
    near = surroundings(cells).where("cluster_id IS NOT NULL").agg(F.avg(F.size(F.array_distinct(F.array_append("beside", F.col("cluster_id"))))).alias("c"))
    return away.crossJoin(near).select("avg_weight", F.round("d", 6).alias("max_weight_deviation"), F.round("c", 6).alias("avg_connectivity"))


def imbalance(cells: DataFrame, k: int) -> DataFrame:
    """One row: the heaviest minus the lightest of the weights of clusters 0 to k - 1; a cluster without cells weighs 0."""
    every = cells.sparkSession.range(k).select(F.col("id").alias("cluster_id"))
    weight = F.coalesce("weight", F.lit(0))
    return every.join(cluster_weights(cells), "cluster_id", "left").agg((F.max(weight) - F.min(weight)).alias("imbalance"))


def missing_clusters(cells: DataFrame, k: int) -> DataFrame:
    """The clusters below k that no cell has."""
    return cells.sparkSession.range(k).select(F.col("id").alias("cluster_id")).join(cells.select("cluster_id").distinct(), "cluster_id", "left_anti")


def frontier(cells: DataFrame) -> DataFrame:
    """Agents with a 4-neighbour in another cluster, and the share of such neighbours (``penalty``). cells: dense, cluster_id null off agents."""
    other = F.size(F.filter("beside", lambda x: x != F.col("cluster_id")))
    return surroundings(cells).where("cluster_id IS NOT NULL").withColumn("penalty", F.when(F.size("beside") > 0, other / F.size("beside")).otherwise(F.lit(0.0))).where("penalty > 0").select("row", "col", "cell_id", "cluster_id", F.round("penalty", 6).alias("penalty"))


def communication(cells: DataFrame) -> DataFrame:
    """One row: neighbouring pairs of agents (right and down) in different clusters."""
    right, down = F.lead("cluster_id").over(W.partitionBy("row").orderBy("col")), F.lead("cluster_id").over(W.partitionBy("col").orderBy("row"))
    both = cells.select("cluster_id", right.alias("r"), down.alias("d"))
    return both.agg((F.count_if(F.col("r") != F.col("cluster_id")) + F.count_if(F.col("d") != F.col("cluster_id"))).alias("communication_edges"))
