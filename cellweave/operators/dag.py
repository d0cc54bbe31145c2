"""Partitioning of DAGs and trees; edges are (ord, child, parent)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import cut, ranked


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()


def topological(edges: DataFrame) -> DataFrame:
    """(node, level, key): the longest-path level, and a key whose order within a level is that of a first-in-first-out peel.

    A node follows its last parent, which stands one level above; so its key is
    that parent's key and the edge's ord, and roots begin with their id.  One
    round a level; nodes on cycles never become free and are left out.
    """
    edges = cut(edges.select("ord", "child", "parent"))
    waiting = edges.groupBy("child").agg(F.count("*").alias("need"))
    level = nodes(edges).join(waiting, F.col("node") == F.col("child"), "left_anti").select("node", F.lit(0).alias("level"), F.array(F.col("node")).alias("key"))
    level = cut(level)
    done, n = level, 0
    # Arrivals of parents that are done, for children that still wait.
    met = None
    while not level.isEmpty():
        arrive = edges.join(level, edges["parent"] == level["node"]).select("child", F.array_append("key", F.col("ord")).alias("key"), F.lit(n).alias("from"))
        got = arrive.groupBy("child").agg(F.count("*").alias("have"), F.max(F.struct("from", "key")).alias("last"))
        if met is not None:
            got = got.unionByName(met).groupBy("child").agg(F.sum("have").alias("have"), F.max("last").alias("last"))
        seen = cut(got.join(waiting, "child"))
        n += 1
        level = seen.where("have = need").select(F.col("child").alias("node"), F.lit(n).alias("level"), F.col("last.key").alias("key"))
        met = seen.where("have < need").select("child", "have", "last")
        done = done.unionByName(level)
        if n % 20 == 0:
            done = cut(done)
    return done


def topological_order(edges: DataFrame) -> DataFrame:
    """(node, level, rank): ranks from 0 over all levels."""
    return ranked(topological(edges), [F.col("level"), F.col("key")]).select("node", "level", "rank")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("ord", F.col("parent").alias("child"), F.col("child").alias("parent"))


def topological_chunks(edges: DataFrame, k: int) -> DataFrame:
    """(node, rank, cluster_id): chunks of ceil(n/k) of the order, the last with what is over."""
    order = cut(topological_order(edges))
    size = max(1, math.ceil(order.count() / k))
    return order.select("node", "rank", F.least(F.expr(f"rank div {size}"), F.lit(k - 1)).alias("cluster_id"))


def topological_even(edges: DataFrame, k: int) -> DataFrame:
    """(node, rank, cluster_id): k (at most n) chunks whose sizes differ by one at most, the larger first.

    If cycles leave later chunks empty, each takes the last node of the largest.
    """
    order = cut(topological_order(edges))
    n, have = nodes(edges).count(), order.count()
    k = max(1, min(k, n))
    size, extra = divmod(n, k)
    bounds, start = [], 0
    for c in range(k):
        end = min(start + size + (c < extra), have)
        bounds.append([start, max(start, end)])
        start = max(start, end)
    moved: dict[int, int] = {}
    for c in range(k):
        if bounds[c][0] == bounds[c][1] and c not in moved.values():
            largest = max(range(k), key=lambda x: (bounds[x][1] - bounds[x][0], -x))
            if bounds[largest][1] - bounds[largest][0] > 1:
                bounds[largest][1] -= 1
                moved[bounds[largest][1]] = c
    wide = extra * (size + 1)
    cluster = F.when(F.col("rank") < wide, F.expr(f"rank div {size + 1}")).otherwise(F.expr(f"{extra} + (rank - {wide}) div {max(1, size)}"))
    for rank, c in moved.items():
        cluster = F.when(F.col("rank") == rank, F.lit(c).cast("bigint")).otherwise(cluster)
    return order.select("node", "rank", cluster.alias("cluster_id"))


def quotient(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """(from_cluster, to_cluster, edges) between different clusters, from parents to children."""
    a = assignment.select(F.col("node").alias("parent"), F.col("cluster_id").alias("from_cluster"))
    b = assignment.select(F.col("node").alias("child"), F.col("cluster_id").alias("to_cluster"))
    return edges.join(a, "parent").join(b, "child").where("from_cluster <> to_cluster").groupBy("from_cluster", "to_cluster").agg(F.count("*").alias("edges"))


def violations(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: edges whose child lies in an earlier cluster than its parent."""
    return quotient(edges, assignment).agg(F.coalesce(F.sum(F.when(F.col("to_cluster") < F.col("from_cluster"), F.col("edges"))), F.lit(0)).alias("violations"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether a peel of free nodes leaves any."""
    return topological(edges).count() < nodes(edges).count()


def clusters_cyclic(edges: DataFrame, assignment: DataFrame) -> bool:
    between = quotient(edges, assignment)
    return has_cycle(between.select(F.lit(0).alias("ord"), F.col("to_cluster").alias("child"), F.col("from_cluster").alias("parent")))


def tree(edges: DataFrame, root: int | None = None) -> DataFrame:
    """(node, parent, ord, depth, path, key) below a root, by default the smallest node that is nobody's child.

    path holds the nodes from the root, key the edges' ords; a node with
    several parents appears once for each way to it.  Without a root: ValueError.
    """
    edges = cut(edges.select("ord", "child", "parent"))
    if root is None:
        root = nodes(edges).join(edges, F.col("node") == F.col("child"), "left_anti").agg(F.min("node")).first()[0]
        if root is None:
            raise ValueError("no node is without a parent")
    spark = edges.sparkSession
    none = F.lit(None).cast("bigint")
    level = spark.range(1).select(F.lit(root).cast("bigint").alias("node"), none.alias("parent"), none.alias("ord"), F.lit(0).alias("depth"), F.array(F.lit(root).cast("bigint")).alias("path"), F.expr("cast(array() as array<bigint>)").alias("key"))
    done = level = cut(level)
    n = 0
    while True:
        up = level.select(F.col("node").alias("parent"), "depth", "path", "key")
        level = cut(edges.join(up, "parent").select(F.col("child").alias("node"), "parent", "ord", (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child")).alias("path"), F.array_append("key", F.col("ord")).alias("key")))
        if level.isEmpty():
            return done
        done, n = done.unionByName(level), n + 1
        if n % 20 == 0:
            done = cut(done)


def longest_path(t: DataFrame) -> list[int]:
    """The longest way from the root; of several, the least as a list of nodes."""
    r = t.agg(F.max(F.struct("depth", F.transform("path", lambda x: -x).alias("p"))).alias("m")).first()["m"]
    return [-x for x in r["p"]]


def longest_paths(t: DataFrame) -> DataFrame:
    """(path) of all longest ways."""
    deepest = t.agg(F.max("depth").alias("_most"))
    return t.join(F.broadcast(deepest), F.col("depth") == F.col("_most"), "left_semi").select("path")


def _literal(path: Sequence[int]) -> Column:
    return F.array(*[F.lit(x).cast("bigint") for x in path])


def hanging_subtrees(t: DataFrame, path: Sequence[int]) -> DataFrame:
    """(node, subtree, spot, root_ord, key): off the path, each node with the root of its subtree.

    Nodes on the path begin every node's own way from the root, so the subtree's
    root is the first node after them; ``spot`` is the place on the path it hangs on.
    """
    common = F.size(F.array_intersect("path", _literal(path)))
    off = t.where(~F.array_contains(_literal(path), F.col("node")))
    return off.select("node", F.get("path", common).alias("subtree"), (common - 1).alias("spot"), F.get("key", common - 1).alias("root_ord"), "key", "path", "depth")


def subtree_sizes(hanging: DataFrame) -> DataFrame:
    """(subtree, spot, root_ord, size) in order along the path, then by edge."""
    return hanging.groupBy("subtree", "spot", "root_ord").agg(F.count("*").alias("size"))


def size_report(sizes: DataFrame) -> DataFrame:
    """sizes with mean_size, median_size, deviation_pct from the median, and oversized (over 150 % away)."""
    total = sizes.agg(F.avg("size").alias("mean_size"), F.median("size").alias("median_size"))
    away = (F.col("size") - F.col("median_size")) * 100 / F.col("median_size")
    return sizes.crossJoin(F.broadcast(total)).withColumn("deviation_pct", F.when(F.col("median_size") != 0, away).otherwise(F.lit(0.0))).withColumn("oversized", F.abs("deviation_pct") > 150)


def cluster_report(assignment: DataFrame) -> DataFrame:
    """(cluster_id, size, mean_size, median_size, stddev_size, deviation_pct, oversized): sizes against the median."""
    sizes = assignment.groupBy("cluster_id").agg(F.count("*").alias("size"))
    total = sizes.agg(F.avg("size").alias("mean_size"), F.median("size").alias("median_size"), F.stddev_pop("size").alias("stddev_size"))
    away = (F.col("size") - F.col("median_size")) * 100 / F.col("median_size")
    return sizes.crossJoin(F.broadcast(total)).withColumn("deviation_pct", away).withColumn("oversized", F.col("deviation_pct") > 150)


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(first, end) of min(k/2, length/3) contiguous parts of a path, the longer ones first; none if that is 0."""
    n = min(k // 2, length // 3)
    if n <= 0:
        return []
    size, extra = divmod(length, n)
    starts = [c * size + min(c, extra) for c in range(n + 1)]
    return list(zip(starts[:-1], starts[1:], strict=True))


def pack_largest_first(sizes: Sequence[int], bins: int) -> list[int]:
    """A bin for each size: the largest first (equal ones in their order), each into the least loaded bin, ties to the lowest."""
    loads, where = [0] * max(1, bins), [0] * len(sizes)
    for n in sorted(range(len(sizes)), key=lambda n: -sizes[n]):
        where[n] = loads.index(min(loads))
        loads[where[n]] += sizes[n]
    return where


#: Of the sizes that are equal, in their order, those from first to end: (size, first, end).
Run = tuple[int, int, int]


def pack_runs(counts: Iterable[tuple[int, int]], bins: int) -> list[tuple[Run, list[int]]]:
    """``pack_largest_first`` of (size, count) with the largest size first: runs, and the bins that take a run's sizes in turn.

    The least loaded bin's load is the least of load + n * size over all bins
    and n; so bins take turns in the order of the rest of load by size, each
    from the round on in which it is reached.
    """
    loads, out = [0] * max(1, bins), []
    for size, count in counts:
        low, done = min(loads), 0
        place = [divmod(x - low, size) for x in loads]
        rounds = sorted({q for q, _ in place})
        for q, after in zip(rounds, [*rounds[1:], None], strict=True):
            turn = sorted((b for b in range(len(loads)) if place[b][0] <= q), key=lambda b: (place[b][1], b))
            end = count if after is None else min(count, done + (after - q) * len(turn))
            if end > done:
                out.append(((size, done, end), turn))
            for n, b in enumerate(turn):
                loads[b] += size * ((end - done + len(turn) - 1 - n) // len(turn))
            done = end
    return out


def merge_runs(counts: Iterable[tuple[int, int]], last: Sequence[int], k: int) -> list[list[Run]]:
    """The two smallest of sizes merged until there are k: the groups as runs, the last merged first, then by size.

    Of equal sizes the last merged go first, then ``counts`` (size, count), then
    ``last``, whose runs are (-1, place, place + 1).  Equal neighbours are
    merged by halving whole runs, so the work grows with the different sizes.
    """
    # A block is a group's runs, or (size, first, end, width, back): groups of ``width`` sizes each, from the end if ``back``.
    heap: list[tuple[int, int, list[Run] | tuple]] = [(s, 0, (s, 0, n, 1, False)) for s, n in counts]
    heap += [(s, n + 1, [(-1, n, n + 1)]) for n, s in enumerate(last)]
    heapq.heapify(heap)
    left = sum(b[2] for _, _, b in heap if isinstance(b, tuple)) + len(last)

    def divided(block, n: int):
        """The first n groups of a block, and the others or None."""
        if isinstance(block, list):
            return block, None
        s, a, b, width, back = block
        at = b - n * width if back else a + n * width
        head, rest = ((s, at, b, width, back), (s, a, at, width, back)) if back else ((s, a, at, width, back), (s, at, b, width, back))
        return head, rest if rest[1] < rest[2] else None

    def runs_of(block) -> list[Run]:
        return block if isinstance(block, list) else [block[:3]]

    size_of = lambda block: 1 if isinstance(block, list) else (block[2] - block[1]) // block[3]
    merges = 0
    while left > k:
        weight, key, block = heapq.heappop(heap)
        pairs = min(size_of(block) // 2, left - k)
        if pairs:
            (s, a, b, width, back), rest = divided(block, 2 * pairs)
            merged, merges = (2 * weight, (s, a, b, 2 * width, not back)), merges + pairs
        else:
            other, at, second = heapq.heappop(heap)
            head, rest2 = divided(second, 1)
            rest, merged, merges, pairs = None, (weight + other, runs_of(block) + runs_of(head)), merges + 1, 1
            if rest2:
                heapq.heappush(heap, (other, at, rest2))
        if rest:
            heapq.heappush(heap, (weight, key, rest))
        heapq.heappush(heap, (merged[0], -merges, merged[1]))
        left -= pairs
    out: list[list[Run]] = []
    for _, key, block in sorted(heap, key=lambda x: x[:2]):
        start = len(out)
        while block:
            head, block = divided(block, 1)
            out.append(runs_of(head))
        if merges and key == -merges:
            out.insert(0, out.pop(start))
    return out


#: A piece of a subtree's nodes in depth-first order: (subtree, first, end).
Piece = tuple[int, int, int]


def halve_until(pieces: list[Piece], k: int) -> list[Piece]:
    """Halve the largest piece until there are k, as far as pieces have two nodes."""
    pieces = list(pieces)
    while len(pieces) < k:
        pieces.sort(key=lambda p: p[1] - p[2])
        s, a, b = pieces[0] if pieces else (0, 0, 0)
        if b - a < 2:
            break
        mid = a + (b - a) // 2
        pieces[0:1] = []
        pieces += [(s, a, mid), (s, mid, b)]
    return pieces


def path_moves(path: Sequence[int], off: dict[int, list[int]], cluster_of: dict[int, int]) -> dict[int, int]:
    """Clusters for the nodes at a path's end.

    From the end upward to the first node with off-path children: the tail joins
    the cluster of its first off-path child, without the node itself if it has
    several such children.  Nodes above, up to the next such node, stay.
    """
    for n in range(len(path) - 1, -1, -1):
        children = off.get(path[n])
        if children:
            target = cluster_of.get(children[0])
            if target is None:
                return {}
            return dict.fromkeys(path[n + (len(children) > 1) :], target)
    return {}


def merge_to(sizes: list[int], levels: list[int], k: int) -> list[int]:
    """A new cluster for each: merge the two mergeable clusters of closest sizes (the first pair wins) until there are k.

    The last cluster of each level is kept apart; with fewer than two others the
    merging ends early.
    """
    groups = [[c] for _, c in sorted((lv, c) for c, lv in enumerate(levels))]
    level_of = sorted(levels)
    last = {lv: max(n for n, x in enumerate(level_of) if x == lv) for lv in set(level_of)}
    while len(groups) > k:
        free = [n for n in range(len(groups)) if n not in last.values()]
        if len(free) < 2:
            break
        total = lambda n: sum(sizes[c] for c in groups[n])
        a, b = min(((x, y) for i, x in enumerate(free) for y in free[i + 1 :]), key=lambda p: (abs(total(p[0]) - total(p[1])), p))
        groups[a] = groups[a] + groups.pop(b)
        last = {lv: n - (n >= b) for lv, n in last.items()}
    out = [0] * len(sizes)
    for n, g in enumerate(groups):
        for c in g:
            out[c] = n
    return out


def cluster_levels(edges: DataFrame, assignment: DataFrame, path: Sequence[int]) -> dict[int, int]:
    """Level of each cluster: 0 for the first with a node of the path, then breadth first over parent-to-child edges; -1 if not reached."""
    starts = assignment.where(F.col("node").isin([int(x) for x in path])).agg(F.min("cluster_id")).first()[0]
    near: dict[int, set[int]] = {}
    for r in quotient(edges, assignment).select("from_cluster", "to_cluster").collect():  # at most k squared
        near.setdefault(r[0], set()).add(r[1])
    ids = [r[0] for r in assignment.select("cluster_id").distinct().collect()]
    levels, front = ({starts: 0} if starts is not None else {}), ([starts] if starts is not None else [])
    while front:
        reached = {c for f in front for c in near.get(f, ()) if c not in levels}
        levels |= dict.fromkeys(reached, levels[front[0]] + 1)
        front = sorted(reached)
    return {c: levels.get(c, -1) for c in ids}


def _relabelled(assignment: DataFrame, new: dict[int, int]) -> DataFrame:
    rows = assignment.sparkSession.createDataFrame(list(new.items()) or [(0, 0)], "cluster_id bigint, _new bigint")
    return assignment.join(F.broadcast(rows), "cluster_id").select(*[F.col("_new").alias("cluster_id") if c == "cluster_id" else c for c in assignment.columns])


def _decomposed(edges: DataFrame, root: int | None):
    """The tree's longest path, those of oversized subtrees, (node, subtree, key) of all other nodes, and (subtree, size, at), at being the order.

    An oversized subtree is replaced by the subtrees off its own longest path;
    all of them are split in one pass.
    """
    path_tree = cut(tree(edges, root))
    path = longest_path(path_tree)
    hanging = cut(hanging_subtrees(path_tree, path))
    sizes = cut(size_report(subtree_sizes(hanging)))
    big = hanging.join(sizes.where("oversized").select("subtree"), "subtree").withColumn("rel", F.expr("slice(path, spot + 2, size(path))")).withColumn("relkey", F.expr("slice(key, spot + 2, size(key))"))
    longest = F.max(F.struct(F.size("rel"), F.transform("rel", lambda x: -x).alias("p")))["p"]
    own = cut(big.groupBy("subtree").agg(F.transform(longest, lambda x: -x).alias("lp"), F.min("spot").alias("_spot"), F.min("root_ord").alias("_ord")))
    split = big.join(own, "subtree").where(~F.array_contains("lp", F.col("node"))).withColumn("_c", F.size(F.array_intersect("rel", "lp")))
    below = cut(split.select("node", F.get("rel", F.col("_c")).alias("subtree"), F.col("relkey").alias("key"), "_spot", "_ord", F.col("_c"), F.get("relkey", F.col("_c") - 1).alias("_o")))
    rest = hanging.join(sizes.where("oversized").select("subtree"), "subtree", "left_anti").select("node", "subtree", "key")
    at = lambda step, *columns: F.struct(F.lit(step).alias("step"), *[F.expr(c).cast("bigint").alias(n) for n, c in zip(("spot", "ord", "c", "o"), columns, strict=True)]).alias("at")
    whole = sizes.where("NOT oversized").select("subtree", "size", at(0, "spot", "root_ord", "0", "0"))
    parts = below.groupBy("subtree", "_spot", "_ord", "_c", "_o").agg(F.count("*").alias("size")).select("subtree", "size", at(1, "_spot", "_ord", "_c", "_o"))
    more = [list(r["lp"]) for r in own.orderBy("_spot", "_ord").collect()]
    return path, more, cut(rest.unionByName(below.select("node", "subtree", "key"))), cut(whole.unionByName(parts))


def _listed(order: DataFrame) -> list[tuple[int, int]]:
    """(subtree, size) in order, on the driver: for few subtrees."""
    return [(r["subtree"], r["size"]) for r in order.orderBy("at").collect()]


def _decompose(edges: DataFrame, root: int | None):
    """``_decomposed`` with the subtrees as a list, for small trees."""
    path, more, hanging, order = _decomposed(edges, root)
    return path, more, hanging, _listed(order)


def _size_counts(order: DataFrame) -> list[tuple[int, int]]:
    """(size, count), the largest first: about the root of twice the nodes at most."""
    return sorted(((r["size"], r["count"]) for r in order.groupBy("size").count().collect()), reverse=True)


def _labelled(order: DataFrame, counts: list[tuple[int, int]], runs: list[tuple[Run, list[int]]]) -> DataFrame:
    """(subtree, cluster_id): of a run's subtrees, in order, each takes the next of its clusters in turn."""
    spark, start, starts = order.sparkSession, 0, {}
    for size, count in counts:
        starts[size] = start
        start += count
    rows = [(s, starts[s] + a, starts[s] + b, clusters) for (s, a, b), clusters in runs]
    table = spark.createDataFrame(rows, "size bigint, _a bigint, _b bigint, _clusters array<bigint>")
    placed = ranked(order, [-F.col("size"), F.col("at"), F.col("subtree")])
    met = placed.join(F.broadcast(table), "size").where((F.col("rank") >= F.col("_a")) & (F.col("rank") < F.col("_b")))
    turn = F.get("_clusters", F.pmod(F.col("rank") - F.col("_a"), F.size("_clusters")).cast("int"))
    return met.groupBy("subtree").agg(F.max_by(turn, "at").alias("cluster_id"))


def partition_longest_path(edges: DataFrame, k: int, root: int | None = None) -> DataFrame:
    """(node, cluster_id): subtrees off the longest path packed into k-1 clusters, the path as one more, its tail moved, merged to k.

    The driver holds paths and one row a cluster or different size of subtrees;
    nodes and subtrees stay distributed and are labelled by joins.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    path, more, hanging, order = _decomposed(edges, root)
    spark = edges.sparkSession
    counts = _size_counts(order)
    packed = pack_runs(counts, max(1, k - 1))
    used = {b: n for n, b in enumerate(sorted({b for (_, first, end), turn in packed for b in turn[: end - first]}))}
    labels = cut(_labelled(order, counts, [(run, [used.get(b, -1) for b in turn]) for run, turn in packed]))
    own = len(used)
    paths = [path, *more]
    on_path = {n: own for p in paths for n in p}
    off = _off_children(edges, paths)
    first = spark.createDataFrame([(int(c[0]),) for c in off.values()], "subtree bigint")
    cluster_of = {r["subtree"]: r["cluster_id"] for r in labels.join(first, "subtree").collect()}
    for p in paths:
        moved = path_moves(p, {n: off.get(n, []) for n in p}, cluster_of)
        on_path |= moved
        cluster_of |= moved
    path_rows = spark.createDataFrame(list(on_path.items()), "node bigint, cluster_id bigint")
    out = cut(hanging.join(labels, "subtree").select("node", "cluster_id").unionByName(path_rows))
    counts = {r[0]: r[1] for r in out.groupBy("cluster_id").count().collect()}
    if len(counts) > k:
        levels = cluster_levels(edges, out, path)
        ids = sorted(counts)
        merged = merge_to([counts[c] for c in ids], [levels[c] for c in ids], k)
        out = _relabelled(out, dict(zip(ids, merged, strict=True)))
    return out


def _off_children(edges: DataFrame, paths: list[list[int]]) -> dict[int, list[int]]:
    """Of the nodes on the paths, the first child off them by the order of edges; twice, if there are more."""
    on = edges.sparkSession.createDataFrame([(int(n),) for p in paths for n in p], "_on bigint").distinct()
    kept = edges.join(F.broadcast(on), F.col("parent") == F.col("_on"), "left_semi").join(F.broadcast(on), F.col("child") == F.col("_on"), "left_anti")
    found = kept.groupBy("parent").agg(F.min(F.struct("ord", "child"))["child"].alias("first"), F.count("*").alias("n"))
    return {r["parent"]: [r["first"]] * min(2, r["n"]) for r in found.collect()}


def partition_critical_path(edges: DataFrame, k: int, root: int | None = None) -> DataFrame:
    """(node, cluster_id): segments of the longest path and subtrees, halved or merged until there are k clusters, without losing a node.

    Too few: the largest part is halved in depth-first order.  Too many: the two
    smallest are merged.  Paths of split subtrees then join the cluster of a
    neighbour.  The driver holds paths and one row a cluster or different size
    of subtrees; subtrees come to it only if there are k or fewer.
    """
    path, more, hanging, order = _decomposed(edges, root)
    spark = edges.sparkSession
    ends = segments(len(path), k) or [(0, len(path))]
    counts = _size_counts(order)
    if sum(n for _, n in counts) + len(ends) > k:
        groups = merge_runs(counts, [b - a for a, b in ends], k)
        labels = _labelled(order, counts, [(run, [c]) for c, g in enumerate(groups) for run in g if run[0] != -1])
        on_path = [(int(n), c) for c, g in enumerate(groups) for s, i, _ in g if s == -1 for n in path[slice(*ends[i])]]
        out = cut(hanging.join(labels, "subtree").select("node", "cluster_id").unionByName(spark.createDataFrame(on_path, "node bigint, cluster_id bigint")))
    else:
        out = cut(_halved(hanging, path, [[(s, 0, n)] for s, n in _listed(order)] + [[(-1, a, b)] for a, b in ends], k))
    rest = [int(n) for p in more for n in p]
    return out.unionByName(spark.createDataFrame(_joined(edges, out, rest), "node bigint, cluster_id bigint")) if rest else out


def _halved(hanging: DataFrame, path: Sequence[int], parts: list[list[Piece]], k: int) -> DataFrame:
    """(node, cluster_id) of k parts or fewer, the largest halved until there are k; subtree -1 is the path."""
    spark = hanging.sparkSession
    weight = lambda p: sum(b - a for _, a, b in p)
    while len(parts) < k:
        at = max(range(len(parts)), key=lambda n: (weight(parts[n]), -n))
        if weight(parts[at]) < 2:
            break
        (s, a, b), *rest = sorted(parts.pop(at), key=lambda p: p[1] - p[2])
        mid = a + (b - a) // 2
        parts += [[(s, a, mid)], [(s, mid, b), *rest]]
    ranges = [(s, a, b, c) for c, p in enumerate(parts) for s, a, b in p]
    table = spark.createDataFrame(ranges, "_s bigint, _a bigint, _b bigint, cluster_id bigint")
    place = F.row_number().over(W.partitionBy("subtree").orderBy("key")) - 1
    placed = hanging.select("node", "subtree", place.alias("place")).unionByName(spark.createDataFrame([(int(n), -1, i) for i, n in enumerate(path)], "node bigint, subtree bigint, place int"))
    inside = (F.col("subtree") == F.col("_s")) & (F.col("place") >= F.col("_a")) & (F.col("place") < F.col("_b"))
    return placed.join(table, inside).select("node", "cluster_id")


def _joined(edges: DataFrame, out: DataFrame, rest: list[int]) -> list[tuple[int, int]]:
    """(node, cluster_id) of nodes on paths of split subtrees, from their ends: the least cluster of a neighbour that has one.

    Neighbours off these paths are brought to their least cluster by a join.
    """
    spark = edges.sparkSession
    on = spark.createDataFrame([(n,) for n in rest], "node bigint").distinct()
    both = edges.select(F.col("parent").alias("node"), F.col("child").alias("other")).unionByName(edges.select(F.col("child").alias("node"), F.col("parent").alias("other")))
    near = cut(both.join(F.broadcast(on), "node").join(F.broadcast(on.select(F.col("node").alias("other"), F.lit(True).alias("_on"))), "other", "left"))
    beside: dict[int, list[int]] = {}
    for r in near.where("_on").select("node", "other").collect():
        beside.setdefault(r["node"], []).append(r["other"])
    least = near.where("_on IS NULL").join(out.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("cluster_id").alias("least"))
    off = {r["node"]: r["least"] for r in least.collect()}
    known: dict[int, int] = {}
    todo = list(reversed(rest))
    while todo:
        left = []
        for n in todo:
            found = ([off[n]] if n in off else []) + [known[x] for x in beside.get(n, ()) if x in known]
            known |= {n: min(found)} if found else {}
            left += [] if found else [n]
        if left == todo:
            break
        todo = left
    return [(n, known[n]) for n in rest if n in known]


def connected(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with ``connected``: an edge either way or a common child."""
    down = edges.select("parent", "child").distinct()
    direct = down.select(F.col("parent").alias("a"), F.col("child").alias("b")).union(down.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    one, two = down.select(F.col("parent").alias("a"), F.col("child").alias("c")), down.select(F.col("parent").alias("b"), F.col("child").alias("c"))
    wanted = pairs.select("a", "b").distinct()
    sharing = wanted.join(one, "a").join(two, ["b", "c"]).select("a", "b")
    found = direct.join(wanted, ["a", "b"], "left_semi").select("a", "b").union(sharing).distinct().withColumn("_yes", F.lit(True))
    return pairs.join(found, ["a", "b"], "left").withColumn("connected", F.coalesce("_yes", F.lit(False))).drop("_yes")


def best_cluster(edges: DataFrame, assignment: DataFrame, left: DataFrame) -> DataFrame:
    """(node, cluster_id) for unassigned nodes (node): the first cluster with a parent or child, else with a parent of a common child, else the smallest."""
    a = assignment.select(F.col("node").alias("other"), "cluster_id")
    both = edges.select(F.col("parent").alias("node"), F.col("child").alias("other")).union(edges.select("child", "parent"))
    direct = left.join(both, "node").join(a, "other").groupBy("node").agg(F.min("cluster_id").alias("first"))
    shared = edges.select(F.col("parent").alias("node"), "child").join(edges.select(F.col("parent").alias("other"), "child"), "child")
    votes = left.join(shared, "node").join(a, "other").groupBy("node", "cluster_id").agg(F.count_distinct("other").alias("n"))
    most = votes.groupBy("node").agg(F.min_by("cluster_id", F.struct(-F.col("n"), F.col("cluster_id"))).alias("most"))
    smallest = assignment.groupBy("cluster_id").count().agg(F.min_by("cluster_id", F.struct("count", "cluster_id")).alias("smallest"))
    return left.join(direct, "node", "left").join(most, "node", "left").crossJoin(F.broadcast(smallest)).select("node", F.coalesce("first", "most", "smallest").alias("cluster_id"))


def dot_lines(edges: DataFrame, assignment: DataFrame | None = None) -> DataFrame:
    """(ord, line): Graphviz text of the edges and the clusters' nodes, to be written as text; the order is given by ord."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(-2, "digraph G {")], "ord bigint, line string")
    tail = edges.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord")).select("ord", F.lit("}").alias("line"))
    lines = edges.select("ord", F.concat(F.lit("  "), F.col("parent"), F.lit(" -> "), F.col("child"), F.lit(";")).alias("line"))
    out = head.unionByName(lines)
    if assignment is not None:
        named = F.concat(F.lit("  "), F.col("node"), F.lit(' [group="c'), F.col("cluster_id"), F.lit('"];'))
        out = out.unionByName(assignment.select(F.lit(-1).cast("bigint").alias("ord"), named.alias("line")))
    return out.unionByName(tail)
