"""Named point sets on a canvas of 1000 by 1000, each a union of primitives over a range of numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import SPARK, Dialect
from ..functions.rng import bits, normal_sql, uniform, uniform_sql
from ..operators.grid_forms import num

SEED = 42
#: A piece: number of points, x and y as expressions of n; {seed} draws follow.
Piece = tuple[int, str, str]


class Pieces:
    """Collects pieces; each gets seeds of its own."""

    def __init__(self, d: Dialect, seed: int = SEED):
        self.d, self.seed, self.pieces = d, seed, []

    def draw(self, which: int) -> str:
        return uniform_sql(self.d, self.seed + 100 * len(self.pieces) + which, "n")

    def bell(self, which: int) -> str:
        return normal_sql(self.d, self.seed + 100 * len(self.pieces) + which, "n")

    def add(self, points: int, x: str, y: str) -> None:
        self.pieces.append((points, x, y))

    def polar(self, points: int, cx: float, cy: float, r: str, a: str) -> None:
        self.add(points, f"{num(cx)} + ({r}) * cos({a})", f"{num(cy)} + ({r}) * sin({a})")

    def circle(self, cx, cy, radius, points, noise):
        self.polar(points, cx, cy, f"{num(radius)} + {self.bell(0)} * {num(noise)}", f"{num(2 * math.pi)} * n / {points}")

    def half_moon(self, cx, cy, radius, angle, points, width):
        self.polar(points, cx, cy, f"{num(radius)} + {self.bell(0)} * {num(width)}", f"{num(math.pi)} * n / {points} + {num(angle)}")

    def blob(self, cx, cy, radius, points):
        self.polar(points, cx, cy, f"{num(radius)} * sqrt({self.draw(1)})", f"{num(2 * math.pi)} * {self.draw(0)}")

    def chain(self, x1, y1, x2, y2, points, width):
        t = f"(n / {num(points)})"
        self.add(points, f"{num(x1)} + {num(x2 - x1)} * {t} + {self.bell(0)} * {num(width)}", f"{num(y1)} + {num(y2 - y1)} * {t} + {self.bell(1)} * {num(width)}")

    def spiral(self, cx, cy, radius, points, start):
        """Two turns, with a jitter of 5."""
        t = f"(n / {num(points)})"
        turn = f"({num(4 * math.pi)} * {t} + {num(start)})"
        self.add(points, f"{num(cx)} + {num(radius)} * {t} * cos({turn}) + {self.bell(0)} * 5", f"{num(cy)} + {num(radius)} * {t} * sin({turn}) + {self.bell(1)} * 5")

    def checkerboard(self, low, high, side, points):
        size = (high - low) / side
        for r in range(side):
            for c in range(r % 2, side, 2):
                self.add(points, f"{num(low + c * size)} + {self.draw(0)} * {num(size)}", f"{num(low + r * size)} + {self.draw(1)} * {num(size)}")

    def fractal(self, cx, cy, size, depth, points):
        """A box and its four corners, each a third the size with a fifth of the points; blobs at the end."""
        if not depth:
            return self.blob(cx, cy, size / 4, points)
        for dx, dy in ((0, 0), (-1, -1), (1, -1), (-1, 1), (1, 1)):
            self.fractal(cx + dx * size / 2, cy + dy * size / 2, size / 3, depth - 1, points // 5)

    def sql(self) -> str:
        parts, first = [], 0
        for points, x, y in self.pieces:
            parts.append(f"SELECT n + {first} AS point_id, {x} AS x, {y} AS y FROM {self.d.numbers(points)} AS t")
            first += points
        return " UNION ALL ".join(parts)


def _on_circle(n: int, of: int, radius: float) -> tuple[float, float]:
    a = 2 * math.pi * n / of
    return 500 + math.cos(a) * radius, 500 + math.sin(a) * radius


def dataset_sql(d: Dialect, name: str) -> str:
    """point_id, x, y of a named set (all but uniform_coverage, which is sequential)."""
    p = Pieces(d)
    if name == "concentric_circles":
        for r, n in ((100, 200), (200, 300), (300, 400)):
            p.circle(500, 500, r, n, 10)
    elif name == "half_moons":
        p.half_moon(500, 400, 200, 0, 300, 20)
        p.half_moon(500, 600, 200, math.pi, 300, 20)
    elif name == "three_blobs":
        for x, y in ((300, 300), (700, 300), (500, 700)):
            p.blob(x, y, 100, 200)
    elif name == "chains":
        p.chain(200, 200, 800, 400, 200, 20)
        p.chain(200, 600, 800, 800, 200, 20)
    elif name == "separated_blobs":
        for x in (300, 700):
            p.blob(x, 500, 150, 300)
    elif name == "checkerboard":
        p.checkerboard(100, 900, 4, 50)
    elif name == "nested_squares":
        for size in (150, 300, 450):
            low, high = 500 - size, 500 + size
            for x1, y1, x2, y2 in ((low, low, high, low), (high, low, high, high), (high, high, low, high), (low, high, low, low)):
                p.chain(x1, y1, x2, y2, 100, 10)
    elif name == "spiral_triple":
        for x, y, a in ((500, 300, math.pi / 2), (300, 700, math.pi), (700, 700, 0)):
            p.spiral(x, y, 200, 200, a)
    elif name == "diamond_pattern":
        for x, y in ((500, 300), (300, 500), (700, 500), (500, 700)):
            p.blob(x, y, 80, 100)
    elif name == "cross_pattern":
        p.chain(200, 500, 800, 500, 300, 20)
        p.chain(500, 200, 500, 800, 300, 20)
    elif name == "gaussian_clusters":
        for x, y in ((300, 300), (700, 300), (500, 700), (300, 700), (700, 700)):
            p.add(100, f"{num(x)} + {p.bell(0)} * 50", f"{num(y)} + {p.bell(1)} * 50")
    elif name == "ring_blobs":
        for n in range(6):
            p.blob(*_on_circle(n, 6, 300), 50, 100)
    elif name == "star_pattern":
        for n in range(5):
            p.chain(500, 500, *_on_circle(n, 5, 400), 150, 15)
    elif name == "double_spiral":
        p.spiral(400, 500, 300, 300, 0)
        p.spiral(600, 500, 300, 300, math.pi)
    elif name == "sine_wave":
        p.add(800, "100e0 + n", f"500 + sin(n * 0.02e0) * 200 + {p.bell(0)} * 20")
    elif name == "nested_triangles":
        for size in (150, 250, 350):
            for n in range(3):
                p.chain(*_on_circle(n, 3, size), *_on_circle((n + 1) % 3, 3, size), 100, 10)
    elif name == "grid_pattern":
        for a in range(4):
            for b in range(4):
                p.blob(200 + 600 * a // 3, 200 + 600 * b // 3, 30, 50)
    elif name == "random_density":
        for n in range(5):
            p.blob(200 + uniform(SEED, n, 1) * 600, 200 + uniform(SEED, n, 2) * 600, 50 + uniform(SEED, n, 3) * 100, 50 + bits(SEED, n, 4) % 150)
    elif name == "concentric_squares":
        # Each side is 4 t * size long for a quarter of t, so half of it is drawn.
        for size in (100, 200, 300):
            t, s = "(n / 100e0)", num(size)
            low, high = num(500 - size), num(500 + size)
            x = f"CASE WHEN n < 25 THEN {low} + {t} * 4 * {s} WHEN n < 50 THEN {high} WHEN n < 75 THEN {high} - ({t} - 0.5e0) * 4 * {s} ELSE {low} END"
            y = f"CASE WHEN n < 25 THEN {low} WHEN n < 50 THEN {low} + ({t} - 0.25e0) * 4 * {s} WHEN n < 75 THEN {high} ELSE {high} - ({t} - 0.75e0) * 4 * {s} END"
            p.add(100, x, y)
    elif name == "x_pattern":
        p.chain(100, 100, 900, 900, 300, 20)
        p.chain(900, 100, 100, 900, 300, 20)
    elif name == "fractal_clusters":
        p.fractal(500, 500, 600, 3, 200)
    elif name == "fibonacci_spiral":
        p.polar(500, 500, 500, "sqrt(n * 1e0) * 15", f"n * {num(4 * math.pi / (1 + math.sqrt(5)))}")
    elif name == "olympic_rings":
        for x, y in ((300, 400), (500, 400), (700, 400), (400, 500), (600, 500)):
            p.circle(x, y, 80, 100, 5)
    elif name == "heart_shape":
        t = f"({num(2 * math.pi)} * n / 1000)"
        p.add(1000, f"500 + 200 * sin({t}) * sin({t}) * sin({t})", f"450 - 200 * (cos({t}) - cos(2 * {t}) / 2 - cos(3 * {t}) / 3 - cos(4 * {t}) / 4)")
    else:
        raise ValueError(name)
    return p.sql()


DATASETS = (
    "concentric_circles", "half_moons", "three_blobs", "chains", "separated_blobs", "checkerboard", "nested_squares", "spiral_triple",
    "diamond_pattern", "cross_pattern", "gaussian_clusters", "ring_blobs", "star_pattern", "double_spiral", "sine_wave", "nested_triangles",
    "grid_pattern", "random_density", "concentric_squares", "x_pattern", "fractal_clusters", "fibonacci_spiral", "olympic_rings", "heart_shape",
)


def uniform_points_sql(d: Dialect, k: int, width: int, height: int, seed: int = SEED) -> str:
    return f"SELECT n AS point_id, {uniform_sql(d, seed, 'n', '1')} * {width} AS x, {uniform_sql(d, seed, 'n', '2')} * {height} AS y FROM {d.numbers(k)} AS t"


def dataset(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(dataset_sql(SPARK, name))


def poisson_disc(low: float, high: float, distance: float, seed: int = SEED) -> list[tuple[float, float]]:
    """Points no closer than ``distance``: from an active point 30 tries in the ring around it, checked on a grid of buckets."""
    size = distance / math.sqrt(2)
    draws = iter(range(10**9))
    u = lambda: uniform(seed, next(draws))
    bucket = lambda x, y: (int((x - low) / size), int((y - low) / size))
    first = (low + u() * (high - low), low + u() * (high - low))
    points, active, taken = [first], [first], {bucket(*first): first}
    while active:
        at = int(u() * len(active))
        px, py = active[at]
        for _ in range(30):
            turn, r = u() * 2 * math.pi, distance * (1 + u())
            x, y = px + r * math.cos(turn), py + r * math.sin(turn)
            if not (low <= x < high and low <= y < high):
                continue
            a, b = bucket(x, y)
            near = (taken.get((a + i, b + j)) for i in range(-2, 3) for j in range(-2, 3))
            if all(q is None or (q[0] - x) ** 2 + (q[1] - y) ** 2 >= distance**2 for q in near):
                taken[a, b] = (x, y)
                points.append((x, y))
                active.append((x, y))
                break
        else:
            active[at] = active[-1]
            active.pop()
    return points


def uniform_coverage(spark: SparkSession) -> DataFrame:
    """Two coverings of a square, at distances 30 and 15. Each is one sequential walk of a few thousand points, run in a task of its own."""
    plans = spark.createDataFrame([(0, 30.0), (1, 15.0)], "part int, distance double")

    def walk(pdf):
        import pandas as pd

        found = poisson_disc(100.0, 900.0, float(pdf["distance"][0]), SEED + int(pdf["part"][0]))
        return pd.DataFrame({"part": int(pdf["part"][0]), "n": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    walked = plans.groupBy("part").applyInPandas(walk, "part int, n bigint, x double, y double")
    return walked.selectExpr("row_number() OVER (ORDER BY part, n) - 1 AS point_id", "x", "y")
