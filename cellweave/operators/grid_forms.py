"""Grid partitioners whose cluster is a function of the cell alone.

Each is an expression of row ``i`` and column ``j``: a projection without a
shuffle at any grid size, and borders follow from the same expression at the
neighbours' places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from ..functions.dialect import Dialect
from ..functions.rng import bits, uniform

Form = Callable[[Dialect, int, int, int, str, str], str]


def num(x: float) -> str:
    """A double literal in both dialects, where 0.5 would be a decimal."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def grid(d: Dialect, rows: int, cols: int, k: int, i: str, j: str) -> str:
    """A near-square lattice of rectangles; remainders widen the first bands."""
    down = max(n for n in range(1, math.isqrt(k) + 1) if k % n == 0)

    def band(x: str, n: int, parts: int) -> str:
        size, extra = divmod(n, parts)
        wide = d.div(x, str(size + 1))
        if not size:
            return wide
        return f"(CASE WHEN {x} < {extra * (size + 1)} THEN {wide} ELSE {extra} + {d.div(f'{x} - {extra * (size + 1)}', str(size))} END)"

    return f"{band(i, rows, down)} * {k // down} + {band(j, cols, k // down)}"


def horizontal(d, rows, cols, k, i, j):
    return f"least({d.div(i, str(-(-rows // k)))}, {k - 1})"


def vertical(d, rows, cols, k, i, j):
    return f"least({d.div(j, str(-(-cols // k)))}, {k - 1})"


def boxes_bsp(rows: int, cols: int, k: int) -> list[tuple[int, int, int, int, int]]:
    """(first row, first column, end row, end column, cluster): halve the clusters, split the longer way in proportion, alternating."""
    out, todo = [], [(0, 0, rows, cols, 0, k, True)]
    while todo:
        top, left, bottom, right, first, n, upright = todo.pop()
        if n == 1:
            out.append((top, left, bottom, right, first))
            continue
        half = n // 2
        if upright:
            mid = left + (right - left) * half // n
            todo += [(top, left, bottom, mid, first, half, False), (top, mid, bottom, right, first + half, n - half, False)]
        else:
            mid = top + (bottom - top) * half // n
            todo += [(top, left, mid, right, first, half, True), (mid, left, bottom, right, first + half, n - half, True)]
    return sorted(out, key=lambda b: b[4])


def bsp(d, rows, cols, k, i, j):
    """Nested decisions: a cell passes about log2(k) comparisons, not k rectangles."""

    def tree(top, left, bottom, right, first, n, upright):
        if n == 1:
            return str(first)
        half = n // 2
        if upright:
            mid = left + (right - left) * half // n
            return f"CASE WHEN {j} < {mid} THEN {tree(top, left, bottom, mid, first, half, False)} ELSE {tree(top, mid, bottom, right, first + half, n - half, False)} END"
        mid = top + (bottom - top) * half // n
        return f"CASE WHEN {i} < {mid} THEN {tree(top, left, mid, right, first, half, True)} ELSE {tree(mid, left, bottom, right, first + half, n - half, True)} END"

    return f"({tree(0, 0, rows, cols, 0, k, True)})"


def _distance(i: str, j: str, ci: float | str, cj: float | str) -> str:
    return f"sqrt(({i} - {ci}) * ({i} - {ci}) * 1e0 + ({j} - {cj}) * ({j} - {cj}))"


def circular(d, rows, cols, k, i, j):
    step = math.sqrt(max(rows, cols) ** 2 / 2) / k
    return f"least({d.trunc(f'{_distance(i, j, rows // 2, cols // 2)} / {num(step)}')}, {k - 1})"


def spiral(d, rows, cols, k, i, j):
    """The place on a clockwise walk inward, in equal quotas."""
    ring = f"least({i}, {j}, {rows - 1} - ({i}), {cols - 1} - ({j}))"
    before = f"(2 * {ring} * ({rows + cols} - 2 * {ring}))"
    wide, high = f"({cols - 1} - 2 * {ring})", f"({rows - 1} - 2 * {ring})"
    along = (
        f"(CASE WHEN {i} = {ring} THEN {j} - {ring} WHEN {j} = {cols - 1} - {ring} THEN {wide} + {i} - {ring} "
        f"WHEN {i} = {rows - 1} - {ring} THEN {wide} + {high} + {cols - 1} - {ring} - {j} ELSE 2 * {wide} + {high} + {rows - 1} - {ring} - {i} END)"
    )
    return f"least({d.div(f'{before} + {along}', str(max(1, rows * cols // k)))}, {k - 1})"


def diagonal(d, rows, cols, k, i, j):
    return f"least({d.div(f'{i} + {j}', str(-(-(rows + cols) // k)))}, {k - 1})"


def checkerboard(d, rows, cols, k, i, j):
    side = math.ceil(math.sqrt(k))
    size = max(1, max(rows, cols) // side)
    return f"(({d.div(i, str(size))} * {side} + {d.div(j, str(size))}) % {k})"


def fractal(d, rows, cols, k, i, j):
    """Order along a bit-interleaved curve of 4**order squares (two bits a level, the second flipped by the first)."""
    order = next(n for n in range(64) if 4**n >= k)
    x, y = d.div(f"({i}) * {1 << order}", str(rows)), d.div(f"({j}) * {1 << order}", str(cols))
    place = " + ".join([f"{d.xor(f'3 * (({x} >> {t}) & 1)', f'(({y} >> {t}) & 1)')} * {4**t}" for t in range(order)] or ["0"])
    return f"least({d.trunc(f'({place}) / {num(4**order / k)}')}, {k - 1})"


def honeycomb(d, rows, cols, k, i, j):
    size = math.sqrt(rows * cols / (k * 2.598))
    q = d.half_up(f"({num(2.0 / 3)} * {j}) / {num(size)}")
    r = d.half_up(f"({num(-1.0 / 3)} * {j} + {num(math.sqrt(3) / 3)} * {i}) / {num(size)}")
    return f"(abs({q} * 31 + {r} * 37) % {k})"


def wave(d, rows, cols, k, i, j):
    f = 2 * math.pi * 3 / max(rows, cols)
    return f"least({d.trunc(f'(sin({num(f)} * {i}) + cos({num(f)} * {j}) + 2) / 4 * {k}')}, {k - 1})"


def cross(d, rows, cols, k, i, j):
    """Bands right of and below the centre; the higher band covers the lower."""
    width = min(rows, cols) // (2 * k)
    if not width:
        return f"(0 * ({i}))"
    band = lambda x, c: f"(CASE WHEN {x} >= {c} AND {x} < {c + k * width} THEN {d.div(f'{x} - {c}', str(width))} ELSE 0 END)"
    return f"greatest({band(i, rows // 2)}, {band(j, cols // 2)})"


def _angle(i: str, j: str, rows: int, cols: int) -> str:
    a = f"atan2({i} - {num(rows / 2)}, {j} - {num(cols / 2)})"
    return f"(CASE WHEN {a} < 0 THEN {a} + {num(2 * math.pi)} ELSE {a} END)"


def triangular(d, rows, cols, k, i, j):
    return d.trunc(f"{_angle(i, j, rows, cols)} / {num(2 * math.pi / k)}")


def mosaic(d, rows, cols, k, i, j):
    tile = max(1, int(math.sqrt(rows * cols / k)))
    n = d.trunc(f"sin(({i}) * 0.1e0) * cos(({j}) * 0.1e0) * {tile} * 0.5e0")
    return f"abs(({d.div(f'{i} + {n}', str(tile))} + {d.div(f'{j} + {n}', str(tile))}) % {k})"


def mandelbrot(d, rows, cols, k, i, j):
    """Steps until the orbit of the cell's place in [-2, 2) squared leaves the disc of radius 2, k at most; the inside is cluster 0."""
    return d.orbit(f"(({j} - {num(cols / 2)}) * 4e0 / {cols})", f"(({i} - {num(rows / 2)}) * 4e0 / {rows})", k)


def concentric(d, rows, cols, k, i, j):
    step = math.hypot(rows / 2, cols / 2) / k
    return f"least({d.trunc(f'{_distance(i, j, num(rows / 2), num(cols / 2))} / {num(step)}')}, {k - 1})"


def rotating_squares(d, rows, cols, k, i, j):
    radius = math.hypot(rows / 2, cols / 2) / math.sqrt(k)
    turn = math.pi / (2 * math.sqrt(k))
    return f"(({d.trunc(f'{_distance(i, j, num(rows / 2), num(cols / 2))} / {num(radius)}')} + {d.trunc(f'{_angle(i, j, rows, cols)} / {num(turn)}')}) % {k})"


def sierpinski(d, rows, cols, k, i, j):
    """The length in bits of the common bits of both scaled places."""
    level = next(n for n in range(64) if 3**n >= k)
    both = f"({d.div(f'({j}) * {1 << level}', str(cols))} & {d.div(f'({i}) * {1 << level}', str(rows))})"
    return f"((CASE WHEN {both} = 0 THEN 0 ELSE length(bin({both})) END) % {k})"


def phyllotaxis_seeds(rows: int, cols: int, k: int) -> list[tuple[int, int]]:
    """Golden-angle seeds inside the grid; ids close up over those outside."""
    out = []
    for n in range(k):
        far, turn = math.sqrt(n) * math.sqrt(rows * cols / (math.pi * k)), n * math.pi * (3 - math.sqrt(5))
        x, y = int(cols / 2 + far * math.cos(turn)), int(rows / 2 + far * math.sin(turn))
        if 0 <= x < cols and 0 <= y < rows:
            out.append((y, x))
    return out


def interference(d, rows, cols, k, i, j, seed=42):
    sources = [(int(uniform(seed, s, 1) * rows), int(uniform(seed, s, 2) * cols)) for s in range(min(5, k))]
    f = 2 * math.pi * k / max(rows, cols)
    total = " + ".join(f"sin({_distance(i, j, a, b)} * {num(f)})" for a, b in sources)
    return f"(abs({d.trunc(f'({total} + {len(sources)}) * {k} / {2 * len(sources)}')}) % {k})"


def permutation(seed: int = 42) -> list[int]:
    """256 numbers swapped by replayable draws, twice over."""
    p = list(range(256))
    for n in range(256):
        m = bits(seed, n) % 256
        p[n], p[m] = p[m], p[n]
    return p + p


def perlin_query(d, cells: str, k: int, seed: int = 42, z: float = 0.8) -> str:
    """Gradient noise over a lattice of permuted hashes, at 1/20 of the cell's place and one depth; in stages, so that no hash is written out twice.

    cells is a subquery (i, j, cell_id); the result is (i, j, cell_id, cluster_id).
    """
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    cell = lambda v: f"({d.trunc(f'floor({v} * 0.05e0)')} & 255)"
    part = lambda v: f"({v} * 0.05e0 - floor({v} * 0.05e0))"
    hashes = ", ".join(f"{d.at('p', f'b{a}{b} + {c}')} & 15 AS h{a}{b}{c}" for a, b, c in corners)
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"

    def slope(a: int, b: int, c: int) -> str:
        h, x, y, w = f"h{a}{b}{c}", f"(px - {a})", f"(py - {b})", num(z - c)
        u = f"(CASE WHEN {h} < 8 THEN {x} ELSE {y} END)"
        v = f"(CASE WHEN {h} < 4 THEN {y} WHEN {h} = 12 OR {h} = 14 THEN {x} ELSE {w} END)"
        return f"((1 - 2 * ({h} & 1)) * {u} + (1 - ({h} & 2)) * {v}) AS s{a}{b}{c}"

    blend = lambda t, a, b: f"({a} + {t} * ({b} - {a}))"
    layer = lambda c: blend("fy", blend("fx", f"s00{c}", f"s10{c}"), blend("fx", f"s01{c}", f"s11{c}"))
    noise = blend(num(z * z * z * (z * (z * 6 - 15) + 10)), "l0", "l1")
    return f"""
WITH n1 AS (SELECT i, j, cell_id, {d.array(permutation(seed))} AS p, {cell('i')} AS ci, {cell('j')} AS cj, {part('i')} AS px, {part('j')} AS py FROM {cells} AS c),
n2 AS (SELECT *, {d.at('p', 'ci')} + cj AS a0, {d.at('p', 'ci + 1')} + cj AS a1 FROM n1),
n3 AS (SELECT *, {d.at('p', 'a0')} AS b00, {d.at('p', 'a0 + 1')} AS b01, {d.at('p', 'a1')} AS b10, {d.at('p', 'a1 + 1')} AS b11 FROM n2),
n4 AS (SELECT i, j, cell_id, px, py, {fade('px')} AS fx, {fade('py')} AS fy, {hashes} FROM n3),
n5 AS (SELECT i, j, cell_id, fx, fy, {', '.join(slope(*c) for c in corners)} FROM n4),
n6 AS (SELECT i, j, cell_id, {layer(0)} AS l0, {layer(1)} AS l1 FROM n5)
SELECT i, j, cell_id, cast(abs({d.trunc(f'({noise} + 1) * {k} / 2')} % {k}) as bigint) AS cluster_id FROM n6"""


#: name -> expression
FORMS: dict[str, Form] = {
    "grid": grid,
    "horizontal": horizontal,
    "vertical": vertical,
    "bsp": bsp,
    "circular": circular,
    "spiral": spiral,
    "diagonal": diagonal,
    "checkerboard": checkerboard,
    "fractal": fractal,
    "honeycomb": honeycomb,
    "wave": wave,
    "cross": cross,
    "triangular": triangular,
    "mosaic": mosaic,
    "mandelbrot": mandelbrot,
    "concentric": concentric,
    "rotating_squares": rotating_squares,
    "sierpinski": sierpinski,
    "interference": interference,
}
