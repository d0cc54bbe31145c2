"""Trees, DAGs, graphs and points."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import dag, graph, points
from cellweave.sources import points as point_sets
from cellweave.sources import trees

PATHS = {
    "tree_a": "24,39,38,40,42,41,37,36,35",
    "tree_b": "24,39,38,40,42,41,37,36,35,34,32,31,30,29,4,28,5,6",
}
SUBTREES = {
    "tree_a": "45:3 50:3 55:5 52:3 63:1 62:1 58:3 64:3 66:1",
    "tree_b": "45:3 50:3 55:5 52:3 63:1 62:1 58:3 64:3 66:1 68:2 17:1 22:3 9:7 18:3 16:1 2:3 26:3 7:1",
}


@pytest.mark.parametrize("name", sorted(PATHS))
def test_longest_path_and_subtrees(spark, name):
    t = dag.cut(dag.tree(trees.fixture(spark, name)))
    path = dag.longest_path(t)
    assert ",".join(map(str, path)) == PATHS[name] and dag.longest_paths(t).count() == 4
    report = dag.size_report(dag.subtree_sizes(dag.hanging_subtrees(t, path))).orderBy("spot", "root_ord").collect()
    assert " ".join(f"{r.subtree}:{r.size}" for r in report) == SUBTREES[name]
    assert report[0].median_size == 3 and not any(r.oversized for r in report)


def test_topological_partitions_of_the_river(spark):
    edges = trees.fixture(spark, "river")
    got = dag.cut(dag.topological_even(edges, 4))
    assert sorted(r["count"] for r in got.groupBy("cluster_id").count().collect()) == [13, 14, 14, 14]
    assert dag.quotient(edges, got).agg(F.sum("edges")).first()[0] == 11
    assert dag.violations(edges, got).first()[0] == 0 and not dag.clusters_cyclic(edges, got)
    assert dag.topological(edges).agg(F.max("level")).first()[0] == 17
    first = {r.cluster_id: r.node for r in got.groupBy("cluster_id").agg(F.min_by("node", "rank").alias("node")).collect()}
    assert first == {0: 111, 1: 2402, 2: 115, 3: 4570}


def test_chunks_of_a_random_tree(spark):
    sizes = [r["count"] for r in dag.topological_chunks(trees.random_reverse_tree(spark, 200), 2).groupBy("cluster_id").count().collect()]
    assert sizes == [100, 100]


def test_cycles(spark):
    ring = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 3, 1), (3, 4, 0)], trees.SCHEMA)
    assert dag.has_cycle(ring) and not dag.has_cycle(trees.fixture(spark, "tree_a"))
    assert sorted(r.node for r in dag.topological(ring).collect()) == [0, 4]
    with pytest.raises(ValueError):
        dag.tree(ring.where("ord < 3"))


@pytest.mark.parametrize("name", ["tree_a", "tree_b"])
@pytest.mark.parametrize("k", [1, 3, 5, 8])
def test_tree_partitions_lose_no_node(spark, name, k):
    edges = trees.fixture(spark, name)
    nodes = sorted(r.node for r in dag.nodes(edges).collect())
    longest = dag.partition_longest_path(edges, k).collect()
    assert sorted(r.node for r in longest) == nodes
    critical = dag.partition_critical_path(edges, k).collect()
    assert sorted(r.node for r in critical) == nodes and len({r.cluster_id for r in critical}) == k


def test_oversized_subtrees_are_split(spark):
    # A path of 12, four single twigs, and a subtree of 9 (a chain of 4 with 5 twigs at its top).
    rows = [(n + 1, n) for n in range(11)] + [(20, 1), (21, 2), (22, 3), (23, 4), (30, 5), (31, 30), (32, 31), (33, 32)] + [(40 + n, 30) for n in range(5)]
    edges = spark.createDataFrame([(n, c, p) for n, (c, p) in enumerate(rows)], trees.SCHEMA)
    path, more, hanging, order = dag._decompose(edges, None)
    assert path == list(range(12)) and more == [[30, 31, 32, 33]]
    assert dict(order) == {20: 1, 21: 1, 22: 1, 23: 1, 40: 1, 41: 1, 42: 1, 43: 1, 44: 1}
    for way in (dag.partition_longest_path, dag.partition_critical_path):
        assert sorted(r.node for r in way(edges, 4).collect()) == sorted({x for r in rows for x in r})


def test_packing_and_merging():
    assert dag.pack_largest_first([1, 5, 3, 3], 2) == [0, 0, 1, 1]
    assert dag.segments(18, 5) == [(0, 9), (9, 18)] and dag.segments(9, 8) == [(0, 3), (3, 6), (6, 9)] and dag.segments(2, 8) == []
    assert dag.merge_to([5, 1, 1, 9], [0, 0, 0, 0], 3) == [0, 1, 1, 2]
    assert sorted(dag.halve_until([(1, 0, 5), (2, 0, 1)], 4)) == [(1, 0, 2), (1, 2, 3), (1, 3, 5), (2, 0, 1)]


def _most_collected(monkeypatch, frame) -> list[int]:
    """Gets the number of rows of each collect() from now on."""
    kind, found = type(frame), []
    real = kind.collect

    def collect(self):
        out = real(self)
        found.append(len(out))
        return out

    monkeypatch.setattr(kind, "collect", collect)
    return found


@pytest.fixture(scope="module")
def twigs(spark):
    """A path of 12 whose second node has 300 twigs, and an oversized subtree of 200 twigs."""
    rows = [(n + 1, n) for n in range(11)] + [(100 + n, 1) for n in range(300)] + [(50, 0)] + [(500 + n, 50) for n in range(200)]
    return dag.cut(spark.createDataFrame([(n, c, p) for n, (c, p) in enumerate(rows)], trees.SCHEMA))


def test_longest_path_partition_keeps_subtrees_off_the_driver(twigs, monkeypatch):
    found = _most_collected(monkeypatch, twigs)
    out = dag.partition_longest_path(twigs, 5)
    assert max(found) < 20
    monkeypatch.undo()
    sizes = collections.Counter(r.cluster_id for r in out.collect())
    assert sum(sizes.values()) == 513 and len(sizes) == 5
    # 499 twigs in four bins, one joined by the path of the split subtree, one by the path's end.
    assert max(sizes[c] for c in range(4)) <= 125 + 12


def test_critical_path_partition_keeps_subtrees_off_the_driver(twigs, monkeypatch):
    found = _most_collected(monkeypatch, twigs)
    out = dag.partition_critical_path(twigs, 5)
    assert max(found) < 20
    monkeypatch.undo()
    rows = out.collect()
    assert len(rows) == len({r.node for r in rows}) == 513 and len({r.cluster_id for r in rows}) == 5


def test_runs_are_packed_as_single_sizes():
    draw = random.Random(3)
    for _ in range(300):
        sizes = [draw.choice([1, draw.randint(1, 20)]) for _ in range(draw.randint(0, 60))]
        bins, spots = draw.randint(1, 9), collections.defaultdict(list)
        for n, s in enumerate(sizes):
            spots[s].append(n)
        got = {spots[s][t]: turn[(t - a) % len(turn)] for (s, a, b), turn in dag.pack_runs(sorted(collections.Counter(sizes).items(), reverse=True), bins) for t in range(a, b)}
        assert [got[n] for n in range(len(sizes))] == dag.pack_largest_first(sizes, bins)


def test_runs_are_merged_as_single_sizes():
    draw = random.Random(4)
    for _ in range(300):
        sizes = [draw.choice([1, draw.randint(1, 20)]) for _ in range(draw.randint(0, 60))]
        last, k = [draw.randint(1, 20) for _ in range(draw.randint(1, 4))], draw.randint(1, 10)
        parts = [(s, [n]) for n, s in enumerate([*sizes, *last])]
        while len(parts) > k:
            parts.sort(key=lambda p: p[0])
            parts = [(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]), *parts[2:]]
        spots = collections.defaultdict(list)
        for n, s in enumerate(sizes):
            spots[s].append(n)
        groups = dag.merge_runs(collections.Counter(sizes).items(), last, k)
        got = [sorted(len(sizes) + a if s == -1 else n for s, a, b in g for n in ([0] if s == -1 else spots[s][a:b])) for g in groups]
        want = [sorted(p[1]) for p in parts]
        assert got == want if len(sizes) + len(last) > k else sorted(got) == sorted(want)
    # Nine million sizes at once.
    assert sum(b - a for g in dag.merge_runs([(1, 9_000_000), (2, 1000)], [8, 9], 5) for _, a, b in g) == 9_001_002


def test_edge_scores_of_a_tree(spark):
    edges = trees.attachment_tree(spark, 30)
    below = collections.Counter(range(30))
    pairs = sorted((r.src, r.dst) for r in edges.collect())
    for s, t in sorted(pairs, key=lambda e: -e[1]):
        below[s] += below[t]
    sizes = dict.fromkeys(range(30), 1)
    for s, t in sorted(pairs, key=lambda e: -e[1]):
        sizes[s] += sizes[t]
    assert {(r.src, r.dst): r.score for r in graph.edge_scores(edges, 30).collect()} == {(s, t): (sizes[t] - 1) * (29 - sizes[t]) for s, t in pairs}


def test_graph_clusterings(spark):
    # Two cliques of four joined by one edge.
    rows = [(a + o, b + o) for o in (0, 4) for a in range(4) for b in range(a + 1, 4)] + [(3, 4)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    halves = [{0, 1, 2, 3}, {4, 5, 6, 7}]
    groups = lambda df: sorted({frozenset(x.id for x in rs) for rs in _by(df).values()}, key=min)
    assert groups(graph.edge_betweenness(edges, 2, 8)) == halves
    # Starts are drawn with replacement, so one draw can miss a half.
    assert any(groups(graph.spectral(edges, 2, 8, seed)) == halves for seed in range(4))
    assert graph.component_count(spark.range(9), edges) == 2
    assert graph.score(edges, graph.edge_betweenness(edges, 2, 8)).first().score == pytest.approx(0.7)
    for way in (graph.walktrap(edges, 2, 8), graph.random_walk(edges, 2, 8), graph.label_propagation(spark.range(9), edges, 2)):
        assert sorted(r.id for r in way.collect())[:8] == list(range(8))


def test_spectral_by_joins(spark, monkeypatch):
    """Beyond DENSE vertices the eigenvectors are those of the dense matrix, up to their sign, and so are the clusters."""
    rows, first = [], 0
    for size in (4, 6, 9):  # cliques in a row
        rows += [(a, b) for a in range(first, first + size) for b in range(a + 1, first + size)] + [(first - 1, first)] * (first > 0)
        first += size
    edges = spark.createDataFrame(rows, "src bigint, dst bigint")
    dense = {r.id: r.features for r in graph._dense_vectors(edges, 2, first).collect()}
    found = {r.id: r.features for r in graph.low_vectors(edges, 2, first).collect()}
    assert found.keys() == dense.keys()
    for j in range(2):
        assert abs(sum(dense[v][j] * found[v][j] for v in dense)) == pytest.approx(1, abs=1e-6)
    small = _by(graph.spectral(edges, 3, first))
    monkeypatch.setattr(graph, "DENSE", 5)
    large = _by(graph.spectral(edges, 3, first))
    assert {c: {x.id for x in rs} for c, rs in small.items()} == {c: {x.id for x in rs} for c, rs in large.items()}
    # A vertex without an edge gets a cluster, too.
    assert sorted(x.id for rs in _by(graph.spectral(edges, 3, first + 1)).values() for x in rs) == list(range(first + 1))


def _reached(vertices, pairs):
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for v in sorted(vertices):
        todo = [] if v in out else [v]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = v
                todo += near[x]
    return out


def test_components_against_brute_force(spark):
    r = random.Random(1)
    pairs = sorted({(r.randrange(30), 100 + r.randrange(40)) for _ in range(30)}) + [(200 + n, 201 + n) for n in range(40)] + [(300, 300)]
    vertices = {v for p in pairs for v in p} | {500, 501}
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = graph.components(spark.createDataFrame([(v,) for v in vertices], "id bigint"), edges).collect()
    want = _reached(vertices, pairs)
    assert len(got) == len(want) and {x.id: x.component for x in got} == want and len(set(want.values())) > 5


def test_components_of_the_whole_table_have_sql(spark, tmp_path):
    import __spark_entry__ as e

    # Orders and lines that no modulo of keys would leave in; 7-1007 and 8-1008 are components of their own.
    lines = [(1, 1, 1, 1001), (1, 2, 1, 1002), (2, 3, 2, 1002), (51, 2, 3, 1001), (3, 1, 7, 1007), (50, 1, 8, 1008)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(x.id, x.component) for x in e.queries()["supply_components"](spark, str(tmp_path)).collect()}
    base = 10**9
    assert got == set(_reached({v for x in lines for v in (x[2], x[3] + base)}, [(x[2], x[3] + base) for x in lines]).items())
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert set(db.execute(e.oracle_sql()["supply_components"]).fetchall()) == got


def _by(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.cluster_id].append(r)
    return out


def test_kmeans_separates_blobs(spark):
    got = _by(points.kmeans(point_sets.dataset(spark, "three_blobs"), 3, 50))
    assert sorted(len(v) for v in got.values()) == [200, 200, 200]
    assert points.sweep(point_sets.dataset(spark, "chains"), (2, 4), 5).groupBy("k").agg(F.sum("size").alias("n")).where("n = 400").count() == 2


def test_registered_kmeans_runs_to_the_default_limits(spark, tmp_path, monkeypatch):
    import __spark_entry__ as e

    q, calls = e.queries(), []
    fixed = spark.createDataFrame([(1, 0.0, 0.0, 0)], "point_id bigint, x double, y double, cluster_id bigint")
    monkeypatch.setattr(points, "kmeans", lambda p, k, passes=100, seed=42: calls.append((k, passes)) or fixed)
    q["points_sweep"](spark, str(tmp_path))
    q["points_centroids"](spark, str(tmp_path))
    assert calls == [(k, 100) for k in (2, 4, 8, 16, 32, 64, 4)]
    spark.createDataFrame([(1, [0.0, 1.0])], "vec_id bigint, v array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(graph, "kmeans_features", lambda rows, k, n, passes=50, seed=42: calls.append(passes) or rows)
    q["features_kmeans"](spark, str(tmp_path))
    assert calls[-1] == 50


def test_poisson_discs_keep_their_distance():
    found = point_sets.poisson_disc(0, 100, 10)
    assert len(found) > 40 and min((a - c) ** 2 + (b - d) ** 2 for n, (a, b) in enumerate(found) for c, d in found[:n]) >= 100


def test_point_sets_without_noise(spark):
    heart = point_sets.dataset(spark, "heart_shape").orderBy("point_id").collect()
    assert len(heart) == 1000 and heart[0].x == 500 and heart[0].y == pytest.approx(450 - 200 * (1 - 1 / 2 - 1 / 3 - 1 / 4))
    squares = point_sets.dataset(spark, "concentric_squares")
    assert squares.count() == 300 and squares.agg(F.min("x")).first()[0] == 200


def test_dot_text(spark):
    lines = [r.line for r in dag.dot_lines(trees.fixture(spark, "tree_a")).orderBy("ord").collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and "  24 -> 45;" in lines
