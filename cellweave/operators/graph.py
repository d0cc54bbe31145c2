"""Graph clusterers; a graph is edges (src, dst) with src < dst, and vertices (id, x, y) where a layout is needed."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut
from ..functions.rng import bits, bits_sql, uniform, uniform_sql
from ..functions.dialect import SPARK
from .grid_centres import lloyd

SEED = 42
#: Dense matrices of a graph are made on the driver up to this many vertices; beyond, the same by joins (spectral) or an error.
DENSE = 2000
#: Subspace iteration: vectors beside the wanted ones, the filter's gain a round, and the residual, in shares of the largest eigenvalue's bound, at which it ends.
SPARE, GAIN, SETTLED = 4, 1e5, 1e-7


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("id")).distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest vertex that can be reached, by minimum labels and pointer jumps until none changes."""
    ways = cut(both_ways(edges))
    labels = cut(vertices.select("id", F.col("id").alias("component")))
    total = lambda x: x.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while before is not None:
        near = ways.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.least("component", "near").alias("to"))
        labels = cut(lower.join(labels.select(F.col("id").alias("to"), F.col("component").alias("far")), "to").select("id", F.least("to", "far").alias("component")))
        now = total(labels)
        if now == before:
            break
        before = now
    return labels


def component_count(vertices: DataFrame, edges: DataFrame) -> int:
    return components(vertices, edges).select("component").distinct().count()


def layout(edges: DataFrame, n: int, steps: int = 100, spring: float = 100.0, seed: int = SEED) -> DataFrame:
    """(id, x, y): a force-directed layout; repulsion spring^2/d, attraction d^2/spring, gravity 0.1 to (400, 400), steps clamped to 10.

    Every step moves each vertex by all others, so it runs dense on the driver; ValueError beyond DENSE vertices.
    """
    pairs = _collected(edges, n)
    at = np.array([[uniform(seed, v, 1) * 800, uniform(seed, v, 2) * 800] for v in range(n)]).reshape(-1, 2)
    for _ in range(steps):
        delta = at[:, None] - at[None]
        d = np.maximum(np.sqrt((delta**2).sum(2)), 1.0)
        move = (delta / d[..., None] * (spring**2 / d)[..., None]).sum(1)
        if len(pairs):
            a, b = pairs.T
            pull = delta[a, b] * (d[a, b] / spring)[:, None]
            np.add.at(move, a, -pull)
            np.add.at(move, b, pull)
        move += 0.1 * (400 - at)
        at = at + np.clip(move, -10, 10)
    return edges.sparkSession.createDataFrame([(v, float(x), float(y)) for v, (x, y) in enumerate(at)], "id bigint, x double, y double")


def _collected(edges: DataFrame, n: int) -> np.ndarray:
    if n > DENSE:
        raise ValueError(f"{n} vertices; a dense matrix is made for {DENSE} at most")
    return np.array(edges.select("src", "dst").distinct().collect(), np.int64).reshape(-1, 2)


def _adjacency(edges: DataFrame, n: int) -> np.ndarray:
    a = np.zeros((n, n))
    for s, t in _collected(edges, n):
        a[s, t] = a[t, s] = 1
    return a


def _labelled(edges: DataFrame, labels) -> DataFrame:
    return edges.sparkSession.createDataFrame([(v, int(c)) for v, c in enumerate(labels)], "id bigint, cluster_id bigint")


def kmeans_layout(vertices: DataFrame, k: int, n: int, passes: int = 50, seed: int = SEED) -> DataFrame:
    """k-means on the layout, from k vertices drawn with replacement."""
    chosen = [bits(seed, c) % n for c in range(k)]
    at = {r["id"]: (r["x"], r["y"]) for r in vertices.where(F.col("id").isin(chosen)).collect()}
    return lloyd(vertices, ["x", "y"], [at[v] for v in chosen], passes)[0].select("id", "cluster_id")


def label_propagation(vertices: DataFrame, edges: DataFrame, k: int, passes: int = 50, seed: int = SEED) -> DataFrame:
    """Each vertex takes the most frequent label of its neighbours, ties to the lowest; a vertex without any takes 0.

    Vertices of even and odd ids move in turn, so that no pair swaps for ever.
    """
    ways = cut(both_ways(edges))
    labels = cut(vertices.selectExpr("id", f"{bits_sql(SPARK, seed, 'id')} % {k} AS cluster_id"))
    still = 0
    for n in range(2 * passes):
        votes = ways.where(F.col("src") % 2 == n % 2).join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "cluster_id").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("cluster_id", F.struct(-F.col("n"), F.col("cluster_id"))).alias("new"))
        lonely = F.when(F.col("id") % 2 == n % 2, F.lit(0)).otherwise(F.col("cluster_id")).cast("bigint")
        moved = cut(labels.join(best, "id", "left").select("id", F.coalesce("new", lonely).alias("cluster_id"), F.col("cluster_id").alias("old")))
        still = 0 if moved.where("cluster_id <> old").limit(1).count() else still + 1
        labels = moved.drop("old")
        if still == 2:
            break
    return labels


def _distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v)


def kmeans_features(rows: DataFrame, k: int, n: int, passes: int = 50, seed: int = SEED) -> DataFrame:
    """(id, cluster_id): k-means on ``features`` (array), from k rows drawn with replacement; the driver holds k centres."""
    chosen = [bits(seed, c) % n for c in range(k)]
    at = {r["id"]: list(r["features"]) for r in rows.where(F.col("id").isin(chosen)).collect()}
    centres = [at[v] for v in chosen]
    out = rows
    for _ in range(passes):
        literal = F.array(*[F.struct(F.array(*map(F.lit, c)).alias("f"), F.lit(i).alias("k")) for i, c in enumerate(centres)])
        out = rows.withColumn("cluster_id", F.array_min(F.transform(literal, lambda c: F.struct(_distance(F.col("features"), c["f"]).alias("d"), c["k"].alias("k"))))["k"].cast("bigint"))
        sums = out.groupBy("cluster_id").agg(F.array(*[F.avg(F.get("features", F.lit(p))) for p in range(len(centres[0]))]).alias("v")).collect()
        new = [list(c) for c in centres]
        for r in sums:
            new[r["cluster_id"]] = list(r["v"])
        if new == centres:
            break
        centres = new
    return out.select("id", "cluster_id")


def _applied(ways: DataFrame, state: DataFrame, p: int) -> DataFrame:
    """state (id, degree, x, ...) with ``lx``, the Laplacian applied to the p vectors whose entries at a vertex are x."""
    near = ways.join(state.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(p)]).alias("near"))
    none = F.array_repeat(F.lit(0.0), p)
    return state.join(near, "id", "left").withColumn("lx", F.zip_with("x", F.coalesce("near", none), lambda v, s: F.col("degree") * v - s)).drop("near")


def _products(full: DataFrame, p: int) -> np.ndarray:
    """x'x, x'Lx and (Lx)'Lx over all vertices; the driver gets 3 p * p sums a partition."""

    def part(batches: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((3, p, p))
        for batch in batches:
            if len(batch):
                x, lx = np.stack(batch["x"]), np.stack(batch["lx"])
                total += np.stack([x.T @ x, x.T @ lx, lx.T @ lx])
        yield pd.DataFrame({"sums": [total.ravel().tolist()]})

    found = full.select("x", "lx").mapInPandas(part, "sums array<double>").collect()
    return np.sum([r["sums"] for r in found], axis=0).reshape(3, p, p)


def _turned(full: DataFrame, by: np.ndarray) -> DataFrame:
    def turn(batches: Iterator) -> Iterator:
        for batch in batches:
            if len(batch):
                batch["x"] = list(np.stack(batch["x"]) @ by)
                yield batch

    return full.select("id", "degree", "x").mapInPandas(turn, "id bigint, degree bigint, x array<double>")


def low_vectors(edges: DataFrame, k: int, n: int, rounds: int = 100, seed: int = SEED) -> DataFrame:
    """(id, features): the entries of the Laplacian's k eigenvectors after the first, for vertices 0 to n - 1.

    Subspace iteration with a Chebyshev filter: a step is one join of the edges
    with the vectors; after a round's steps the vectors are made orthogonal by
    matrices of (k + 5)**2 sums, all that the driver holds.  It ends when the
    residuals of all wanted vectors have settled, or after ``rounds`` rounds.
    """
    ways = cut(both_ways(edges).where("src <> dst").distinct())
    p = min(n, k + 1 + SPARE)
    degrees = cut(ways.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")))
    # No eigenvalue exceeds twice the largest degree.
    top = 2.0 * (degrees.agg(F.max("degree")).first()[0] or 0.5)
    start = F.array(F.lit(1.0), *[F.expr(uniform_sql(SPARK, seed + j, "id")) - 0.5 for j in range(1, p)])
    state = cut(edges.sparkSession.range(n).join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), start.alias("x")))
    for made in range(rounds + 1):
        full = cut(_applied(ways, state, p))
        same, once, twice = _products(full, p)
        weights, basis = np.linalg.eigh((same + same.T) / 2)
        held = weights > 1e-13 * weights.max()
        basis = basis[:, held] / np.sqrt(weights[held])
        inner = basis.T @ once @ basis
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        basis = basis @ turn
        p = len(values)
        state = cut(_turned(full, basis))
        residual = np.sqrt(np.maximum(np.diag(basis.T @ twice @ basis) - values**2, 0))
        if made == rounds or residual[: k + 1].max() <= SETTLED * top:
            break
        # Eigenvalues from the last one found to the bound are damped; steps so many that 0 gains GAIN on them.
        low = min(max(values[-1], 1e-9 * top), 0.9 * top)
        half, middle = (top - low) / 2, (top + low) / 2
        first = share = -half / middle
        state = state.withColumn("before", F.transform("x", lambda v: v * 0.0))
        for step in range(max(2, int(math.acosh(GAIN) / math.acosh(middle / half)))):
            following = 1 / (2 / first - share) if step else first
            scale, back = (2 if step else 1) * following / half, share * following if step else 0.0
            grown = F.zip_with("lx", "x", lambda y, v: scale * (y - middle * v))
            state = cut(_applied(ways, state, p).select("id", "degree", F.zip_with(grown, F.col("before"), lambda y, v: y - back * v).alias("new"), F.col("x").alias("before")).withColumnRenamed("new", "x"))
            share = following
    return state.select("id", F.slice("x", 2, k).alias("features"))


def _dense_vectors(edges: DataFrame, k: int, n: int) -> DataFrame:
    """The same as ``low_vectors``, from a dense matrix on the driver."""
    a = _adjacency(edges, n)
    _, vectors = np.linalg.eigh(np.diag(a.sum(1)) - a)
    return edges.sparkSession.createDataFrame([(v, [float(x) for x in r]) for v, r in enumerate(vectors[:, 1 : k + 1])], "id bigint, features array<double>")


def spectral(edges: DataFrame, k: int, n: int, seed: int = SEED) -> DataFrame:
    """k-means on the row-normalised eigenvectors of the Laplacian after the first, at every size; beyond DENSE vertices they come from joins.

    Every vertex from 0 to n - 1 gets a cluster, with edges or without.
    """
    vectors = cut(_dense_vectors(edges, k, n) if n <= DENSE else low_vectors(edges, k, n, seed=seed))
    width = min(k, n - 1)
    # Signs and bases of equal eigenvalues are open; fix the sign by the largest entry.
    entry = [F.get("features", F.lit(j)) for j in range(width)]
    largest = vectors.agg(*[F.max_by(x, F.struct(F.abs(x), -F.col("id"))).alias(f"x{j}") for j, x in enumerate(entry)]).first() if width else []
    signed = vectors.withColumn("features", F.array(*[-x if at is not None and at < 0 else x for x, at in zip(entry, largest, strict=True)]).cast("array<double>"))
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda t, x: t + x * x))
    rows = cut(signed.withColumn("_norm", F.greatest(norm, F.lit(1e-12))).select("id", F.transform("features", lambda x: x / F.col("_norm")).alias("features")))
    return kmeans_features(rows, k, n, seed=seed)


def grid_spectral(rows: int, cols: int, k: int, spark) -> DataFrame:
    """Spectral clustering of a grid's 4-neighbour graph; (cell_id, cluster_id)."""
    cell = spark.range(rows * cols)
    right = cell.where(F.col("id") % cols < cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = cell.where(F.col("id") < (rows - 1) * cols).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    return spectral(right.union(down), k, rows * cols).withColumnRenamed("id", "cell_id")


def edge_scores(edges: DataFrame, n: int) -> DataFrame:
    """(src, dst, score): pairs of other vertices whose path in a breadth-first tree uses the edge.

    Sources are spread over tasks; each walks its own tree over the adjacency
    lists, which are sent once to each executor (their size is checked).
    """
    pairs = _collected(edges, n)
    near: list[list[int]] = [[] for _ in range(n)]
    for s, t in pairs.tolist():
        near[s].append(t)
        near[t].append(s)
    sent = edges.sparkSession.sparkContext.broadcast([sorted(x) for x in near])

    def walk(batches):
        import pandas as pd

        lists = sent.value
        for batch in batches:
            score: dict[tuple[int, int], int] = {}
            for s in batch["id"]:
                parent, order, queue = {s: -1}, [], deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in lists[v]:
                        if w not in parent:
                            parent[w] = v
                            queue.append(w)
                # Later vertices t > s below each vertex, each counted on the edges of its way that touch neither s nor t.
                below = dict.fromkeys(order, 0)
                for v in reversed(order):
                    if parent[v] >= 0:
                        if parent[v] != s and below[v]:
                            e = (min(v, parent[v]), max(v, parent[v]))
                            score[e] = score.get(e, 0) + below[v]
                        below[parent[v]] += below[v] + (v > s)
            yield pd.DataFrame([(a, b, c) for (a, b), c in score.items()], columns=["src", "dst", "score"])

    found = edges.sparkSession.range(n).mapInPandas(walk, "src bigint, dst bigint, score bigint").groupBy("src", "dst").agg(F.sum("score").alias("score"))
    return edges.select("src", "dst").join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("score", F.lit(0)).alias("score"))


def edge_betweenness(edges: DataFrame, k: int, n: int) -> DataFrame:
    """Remove the edge of the highest score, the first of equals, until there are k components; (id, cluster_id) in the order of smallest vertices."""
    spark = edges.sparkSession
    vertices = spark.range(n)
    left = cut(edges.select("src", "dst").distinct())
    labels = components(vertices, left)
    while labels.select("component").distinct().count() < k and not left.isEmpty():
        top = edge_scores(left, n).orderBy(F.desc("score"), "src", "dst").first()
        left = cut(left.where(~((F.col("src") == top["src"]) & (F.col("dst") == top["dst"]))))
        labels = components(vertices, left)
    return numbered(labels)


def numbered(labels: DataFrame) -> DataFrame:
    """Components as cluster ids 0, 1, ... in the order of their smallest vertex."""
    from .grid_centres import compact

    return compact(labels.select("id", F.col("component").alias("cluster_id")))


def walktrap(edges: DataFrame, k: int, n: int, steps: int = 4) -> DataFrame:
    """Agglomeration by the mean distance sqrt(|p_i(j) - p_i(i)|) of walks of four steps, from the earlier to the later cluster; dense."""
    a = _adjacency(edges, n)
    p = np.linalg.matrix_power(a / np.maximum(a.sum(1, keepdims=True), 1), steps)
    d = np.sqrt(np.abs(p - np.diag(p)[:, None]))
    groups = [[v] for v in range(n)]
    while len(groups) > max(1, k):
        sums = d / np.outer([len(g) for g in groups], [len(g) for g in groups])
        sums[np.tril_indices(len(groups))] = np.inf
        x, y = np.unravel_index(sums.argmin(), sums.shape)
        groups[x] = groups[x] + groups.pop(y)
        d[x] += d[y]
        d[:, x] += d[:, y]
        d = np.delete(np.delete(d, y, 0), y, 1)
    labels = np.zeros(n, int)
    for c, g in enumerate(groups):
        labels[g] = c
    return _labelled(edges, labels)


def random_walk_features(edges: DataFrame, n: int, walks: int = 100, steps: int = 3, seed: int = SEED) -> DataFrame:
    """(id, features): how often walks from a vertex visit each vertex, as shares; a vertex without neighbours has zeros."""
    near = both_ways(edges).groupBy(F.col("src").alias("at")).agg(F.array_sort(F.collect_set("dst")).alias("near"))
    walk = edges.sparkSession.range(n * walks).select((F.col("id") % n).alias("id"), (F.col("id") % n).alias("at"), F.col("id").alias("walk"))
    visits = None
    for s in range(steps):
        draw = F.expr(f"cast({bits_sql(SPARK, seed + s, 'walk')} % size(near) as int)")
        walk = walk.join(near, "at").select("id", F.get("near", draw).alias("at"), "walk")
        seen = walk.select("id", "at")
        visits = seen if visits is None else visits.unionAll(seen)
    counts = visits.groupBy("id", "at").agg(F.count("*").alias("n"))
    total = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"), F.sum("n").alias("total"))
    share = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda v: F.coalesce(F.try_element_at("m", v.cast("bigint")) / F.col("total"), F.lit(0.0)))
    return edges.sparkSession.range(n).join(total, "id", "left").select("id", F.coalesce(share, F.array_repeat(F.lit(0.0), n)).alias("features"))


def random_walk(edges: DataFrame, k: int, n: int, seed: int = SEED) -> DataFrame:
    return kmeans_features(cut(random_walk_features(edges, n, seed=seed)), k, n, seed=seed)


def score(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: cut_edges, clusters, size_cv, score = 0.7 * cut edges + 0.3 * vertices * deviation over mean of sizes; lower is better."""
    a, b = (assignment.select(F.col("id").alias(c), F.col("cluster_id").alias(f"_{c}")) for c in ("src", "dst"))
    between = edges.join(a, "src").join(b, "dst").agg(F.count_if(F.col("_src") != F.col("_dst")).alias("cut_edges"))
    sizes = assignment.groupBy("cluster_id").agg(F.count("*").alias("size"))
    shape = sizes.agg(F.count("*").alias("clusters"), (F.stddev_pop("size") / F.avg("size")).alias("size_cv"), F.sum("size").alias("_n"))
    both = between.crossJoin(F.broadcast(shape))
    return both.select("cut_edges", "clusters", F.round("size_cv", 6).alias("size_cv"), F.round(F.col("cut_edges") * 0.7 + F.col("size_cv") * F.col("_n") * 0.3, 6).alias("score"))


def adjacency_lines(edges: DataFrame, n: int) -> DataFrame:
    """(id, line): rows of the adjacency matrix as text of 0 and 1."""
    near = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("near"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda v: F.when(F.array_contains(F.coalesce("near", F.expr("cast(array() as array<bigint>)")), v.cast("bigint")), "1").otherwise("0"))
    return edges.sparkSession.range(n).join(near, "id", "left").select("id", F.array_join(cells, " ").alias("line"))
