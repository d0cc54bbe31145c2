"""Trees and graphs: fixed edge lists, replayable random trees, and adapters from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Dialect
from ..functions.rng import bits_sql

# Edges as child, parent, in their order.
TREE_A = """
45 24, 39 24, 44 45, 46 45, 50 39, 38 39, 57 50, 51 50, 55 38, 40 38,
47 55, 56 55, 52 40, 42 40, 49 47, 48 47, 53 52, 54 52, 63 42, 62 42, 41 42,
58 41, 59 58, 61 58, 37 41, 64 37, 60 64, 65 64, 66 36, 35 36, 36 37
"""
TREE_B = """
45 24, 39 24, 44 45, 46 45, 50 39, 38 39, 57 50, 51 50, 55 38, 40 38,
47 55, 56 55, 52 40, 42 40, 49 47, 48 47, 53 52, 54 52, 63 42, 62 42, 41 42,
58 41, 59 58, 61 58, 37 41, 64 37, 60 64, 65 64, 36 37, 66 36, 35 36, 68 35, 34 35,
69 68, 17 34, 32 34, 22 32, 9 32, 31 32, 23 22, 21 22, 11 9, 15 9,
13 11, 10 11, 14 13, 12 13, 18 31, 30 31, 19 18, 20 18, 16 30, 29 30, 2 29, 4 29,
1 2, 3 2, 28 4, 5 28, 26 28, 7 5, 6 5, 8 26, 25 26
"""
RIVER = """
2043 2040, 2039 2040, 2040 3451, 3450 3451, 3451 2044, 2407 2044, 2044 2045, 2398 2045, 2045 1681,
4295 1680, 4280 4295, 4422 4280, 4653 4280, 1680 183, 1681 114, 183 114, 114 115, 1600 115, 115 192,
574 575, 575 193, 192 193, 193 2265, 2265 2402, 2402 4, 4709 1857, 1857 1444, 1444 198, 4 1444,
197 198, 198 3420, 4649 3420, 3420 110, 201 110, 208 110, 110 111, 194 195, 2072 195, 2072 4709,
549 550, 4570 550, 550 837, 3890 838, 837 838, 2023 2024, 838 2025, 2024 2025, 2025 2032, 2031 2032,
2032 2036, 2036 3, 23 3, 2027 23, 3 4
"""
FIXTURES = {"tree_a": TREE_A, "tree_b": TREE_B, "river": RIVER}
SCHEMA = "ord bigint, child bigint, parent bigint"


def fixture_rows(name: str) -> list[tuple[int, int, int]]:
    return [(n, *map(int, pair.split())) for n, pair in enumerate(FIXTURES[name].split(","))]


def fixture(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(fixture_rows(name), SCHEMA)


def values_sql(name: str) -> str:
    """A subquery (ord, child, parent) with the edges of a fixture."""
    return f"(SELECT * FROM (VALUES {', '.join(map(str, fixture_rows(name)))}) AS v(ord, child, parent))"


def random_reverse_tree_sql(d: Dialect, n: int, seed: int = 42) -> str:
    """Node i from 1 hangs on a node drawn from those before it."""
    return f"SELECT n AS ord, n + 1 AS child, {bits_sql(d, seed, 'n')} % (n + 1) AS parent FROM {d.numbers(max(0, n - 1))} AS t"


def random_reverse_tree(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return spark.sql(random_reverse_tree_sql(SPARK, n, seed))


REPLAY_SQL = "SELECT i - 1 AS ord, i AS child, (i * 7919 + 12345) % i AS parent FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) AS o WHERE i >= 1"


def replay_tree(orders: DataFrame) -> DataFrame:
    """A tree of as many nodes as there are orders; the parent of i is an arithmetic function of i."""
    n = orders.count()
    i = F.col("id")
    return orders.sparkSession.range(1, max(n, 1)).select((i - 1).alias("ord"), i.alias("child"), ((i * 7919 + 12345) % i).alias("parent"))


def geo_tree(region: DataFrame, nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """root 0 -> regions -> nations -> customers -> orders, each level in a range of ids of its own."""
    step = 10**12
    level = lambda df, child, parent, n: df.select((F.col(child).cast("bigint") + n * step).alias("child"), parent.cast("bigint").alias("parent"))
    edges = level(region, "r_regionkey", F.lit(0), 1)
    edges = edges.unionByName(level(nation, "n_nationkey", F.col("n_regionkey") + step, 2))
    edges = edges.unionByName(level(customer, "c_custkey", F.col("c_nationkey") + 2 * step, 3))
    edges = edges.unionByName(level(orders, "o_orderkey", F.col("o_custkey") + 3 * step, 4))
    return edges.select(F.col("child").alias("ord"), "child", "parent")


def attachment_tree(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(src, dst) with src < dst: every vertex from 1 is linked to one drawn from those before it."""
    return random_reverse_tree(spark, n, seed).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
