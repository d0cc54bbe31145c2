"""Cells, weights, masks and soil: one row a cell, all in parallel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, Dialect
from ..functions.frames import ranked
from ..functions.rng import bits, bits_sql, normal_sql, uniform_sql
from ..operators.grid_forms import num

SEED = 42


def cells_sql(d: Dialect, rows: int, cols: int) -> str:
    """(i, j, cell_id) of a dense grid."""
    return f"(SELECT {d.div('n', str(cols))} AS i, n % {cols} AS j, n AS cell_id FROM {d.numbers(rows * cols)} AS t)"


def cells(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """row, col, cell_id."""
    return spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"), F.col("id").alias("cell_id"))


def from_lists(spark: SparkSession, values: list[list[int]]) -> DataFrame:
    """row, col, cell_id, weight of nested lists; the first row gives the width."""
    width = len(values[0]) if values else 0
    if any(len(v) != width for v in values):
        raise ValueError("rows have different lengths")
    frame = spark.createDataFrame([(values,)], "v array<array<int>>")
    rows = frame.select(F.posexplode("v").alias("row", "v"))
    return rows.select("row", F.posexplode("v").alias("col", "weight")).select("row", "col", (F.col("row").cast("bigint") * width + F.col("col")).alias("cell_id"), "weight")


def _from_centre(rows: int, cols: int) -> str:
    return f"sqrt((i - {rows // 2}) * (i - {rows // 2}) * 1e0 + (j - {cols // 2}) * (j - {cols // 2}))"


def weight_sql(d: Dialect, name: str, rows: int, cols: int, most: int = 32, seed: int = SEED) -> str:
    """The weight of a cell as an expression of i and j; ``mountains``, ``sparse_peaks`` and ``fractal`` are queries of their own."""
    u = lambda s: uniform_sql(d, seed + s, "i", "j")
    half_r, half_c = rows // 2, cols // 2
    longest = max(rows, cols)
    if name == "random":
        return f"({bits_sql(d, seed, 'i', 'j')} % {most})"
    if name == "gradient":
        return d.div("(i + j) * 255", str(rows + cols))
    if name == "block":
        return f"(CASE WHEN (i < {half_r}) = (j < {half_c}) THEN 255 ELSE 0 END)"
    if name == "circle":
        return f"(CASE WHEN {_from_centre(rows, cols)} <= {min(rows, cols) // 4} THEN 255 ELSE 0 END)"
    if name == "spiral":
        return d.trunc(f"((atan2((i - {half_r}) * 1e0, (j - {half_c}) * 1e0) + {num(math.pi)}) / {num(2 * math.pi)} + {_from_centre(rows, cols)} / {longest}) * 127")
    if name == "hotspot":
        spots = [(bits(seed, s, 1) % rows, bits(seed, s, 2) % cols) for s in range(5)]
        near = ", ".join(f"sqrt((i - {a}) * (i - {a}) * 1e0 + (j - {b}) * (j - {b}))" for a, b in spots)
        return d.trunc(f"255 * exp(-least({near}) / 20)")
    if name == "checkerboard":
        return f"(CASE WHEN ({d.div('i', '50')} + {d.div('j', '50')}) % 2 = 0 THEN 255 ELSE 0 END)"
    if name == "diagonal_stripes":
        return f"(CASE WHEN {d.div('i + j', '30')} % 2 = 0 THEN 255 ELSE 0 END)"
    if name == "gaussian":
        return d.trunc(f"greatest(0e0, least(255e0, {normal_sql(d, seed, 'i', 'j')} * 64 + 128))")
    if name == "wave":
        return d.trunc("sin(i * 0.1e0) * cos(j * 0.1e0) * 127 + 128")
    if name == "power_law":
        # u ** (-1/2) is 1 at least for u below 1, so every weight is the cap.
        return f"least(255, {d.trunc(f'255 * pow(greatest({u(0)}, 1e-9), -0.5e0)')})"
    if name == "corner_heavy":
        return f"(255 - {d.div(f'least(i + j, {rows - 1} - i + {cols - 1} - j, i + {cols - 1} - j, {rows - 1} - i + j) * 255', str(rows + cols))})"
    if name == "exponential":
        x, y = f"(i / {num(rows)})", f"(j / {num(cols)})"
        return d.trunc(f"255 * exp(-({x} * {x} + {y} * {y}) * 3)")
    if name == "bimodal":
        low, high = bits_sql(d, seed + 1, "i", "j"), bits_sql(d, seed + 2, "i", "j")
        return f"(CASE WHEN {u(0)} < 0.7e0 THEN {low} % 50 ELSE 200 + {high} % 55 END)"
    if name == "step":
        return d.div(f"{d.div('i * 5', str(rows))} * 255", "4")
    if name == "concentrics":
        return d.trunc(f"127 * (1 + cos({_from_centre(rows, cols)} * 0.3e0))")
    if name == "quadrants":
        return f"(CASE WHEN i < {half_r} THEN (CASE WHEN j < {half_c} THEN 255 ELSE 128 END) ELSE (CASE WHEN j < {half_c} THEN 64 ELSE 32 END) END)"
    raise ValueError(name)


WEIGHTS = (
    "random", "gradient", "block", "circle", "spiral", "hotspot", "checkerboard", "diagonal_stripes", "gaussian", "wave",
    "power_law", "corner_heavy", "exponential", "bimodal", "step", "concentrics", "quadrants",
)


def mountains_sql(d: Dialect, rows: int, cols: int, seed: int = SEED) -> str:
    """Noise averaged over 5 by 5 cells, clipped at the edges: noise is a function of the place, so no neighbour is fetched."""
    terms = [(f"i + {a}", f"j + {b}") for a in range(-2, 3) for b in range(-2, 3)]
    inside = lambda x, y: f"({x} >= 0 AND {x} < {rows} AND {y} >= 0 AND {y} < {cols})"
    total = " + ".join(f"CASE WHEN {inside(x, y)} THEN {uniform_sql(d, seed, x, y)} ELSE 0e0 END" for x, y in terms)
    count = " + ".join(f"CASE WHEN {inside(x, y)} THEN 1 ELSE 0 END" for x, y in terms)
    return d.trunc(f"255 * (({total}) / ({count}))")


def sparse_peaks_sql(d: Dialect, rows: int, cols: int, seed: int = SEED) -> str:
    peaks = f"(SELECT DISTINCT {bits_sql(d, seed, 'k', '1')} % {rows} AS pi, {bits_sql(d, seed, 'k', '2')} % {cols} AS pj FROM {d.numbers(rows * cols // 100, 'k')} AS t)"
    return f"SELECT i, j, cell_id, CASE WHEN pi IS NULL THEN 10 ELSE 255 END AS weight FROM {cells_sql(d, rows, cols)} AS c LEFT JOIN {peaks} AS p ON i = pi AND j = pj"


def fractal_sql(d: Dialect, rows: int, cols: int, seed: int = SEED) -> str:
    """Midpoints of nested boxes, level by level; the last box that writes a cell counts, in depth-first order; other cells are 0.

    A box's number has one base-4 digit a level, so its draws are replayable and
    its place in the depth-first order is its number filled up with zeros.
    """
    levels = max(1, math.ceil(math.log2(max(rows, cols, 2))))
    value = lambda v, rough: f"greatest(0, least(255, {v} + {d.trunc(f'{v} * {num(rough)} * ({uniform_sql(d, seed, 'depth', 'path')} - 0.5e0)')}))"
    steps = [f"b0 AS (SELECT 0 AS depth, cast(0 as bigint) AS path, 0 AS x1, 0 AS y1, {rows} AS x2, {cols} AS y2, cast(255 as bigint) AS v0)"]
    rough = 0.5
    for n in range(levels):
        mid_x, mid_y = d.div("x1 + x2", "2"), d.div("y1 + y2", "2")
        steps.append(f"m{n} AS (SELECT depth, path, x1, y1, x2, y2, {mid_x} AS mx, {mid_y} AS my, {value('v0', rough)} AS v FROM b{n} WHERE x2 - x1 >= 2 AND y2 - y1 >= 2)")
        side = "CASE WHEN q % 2 = 0 THEN {0} ELSE {1} END".format
        level = "CASE WHEN q < 2 THEN {0} ELSE {1} END".format
        box = f"{side('x1', 'mx')} AS x1, {level('y1', 'my')} AS y1, {side('mx', 'x2')} AS x2, {level('my', 'y2')} AS y2"
        steps.append(f"b{n + 1} AS (SELECT {n + 1} AS depth, path * 4 + q AS path, {box}, v AS v0 FROM m{n} CROSS JOIN {d.numbers(4, 'q')} AS quarters)")
        rough *= 0.7
    drawn = " UNION ALL ".join(f"SELECT mx, my, v, path * {4 ** (levels - n)} * {levels + 1} + {n} AS ord FROM m{n}" for n in range(levels))
    last = "SELECT mx, my, max_by(v, ord) AS v FROM drawn GROUP BY mx, my"
    return f"WITH {', '.join(steps)}, drawn AS ({drawn}), painted AS ({last}) SELECT i, j, cell_id, coalesce(v, 0) AS weight FROM {cells_sql(d, rows, cols)} AS c LEFT JOIN painted ON i = mx AND j = my"


def weights_sql(d: Dialect, name: str, rows: int, cols: int) -> str:
    """row, col, cell_id, weight."""
    if name == "sparse_peaks":
        body = sparse_peaks_sql(d, rows, cols)
    elif name == "fractal":
        body = fractal_sql(d, rows, cols)
    else:
        expr = mountains_sql(d, rows, cols) if name == "mountains" else weight_sql(d, name, rows, cols)
        body = f"SELECT i, j, cell_id, {expr} AS weight FROM {cells_sql(d, rows, cols)} AS c"
    return f"SELECT cast(i as int) AS {d.q('row')}, cast(j as int) AS {d.q('col')}, cell_id, cast(weight as int) AS weight FROM ({body}) AS w"


ALL_WEIGHTS = (*WEIGHTS, "mountains", "sparse_peaks", "fractal")


def weights(spark: SparkSession, name: str, rows: int, cols: int) -> DataFrame:
    return spark.sql(weights_sql(SPARK, name, rows, cols))


def random_mask_sql(d: Dialect, rows: int, cols: int, ratio: float = 0.3, seed: int = SEED) -> str:
    return f"SELECT cast(i as int) AS {d.q('row')}, cast(j as int) AS {d.q('col')}, cell_id, {uniform_sql(d, seed, 'i', 'j')} < {num(ratio)} AS is_agent FROM {cells_sql(d, rows, cols)} AS c"


def discs(rows: int, cols: int, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Five discs: centre row, centre column, radius 15 to 24."""
    return [(bits(seed, n, 1) % rows, bits(seed, n, 2) % cols, 15 + bits(seed, n, 3) % 10) for n in range(5)]


def disc_mask_sql(d: Dialect, rows: int, cols: int, density: float = 0.7, seed: int = SEED) -> str:
    """Each disc draws its cells anew; a cell is an agent if any disc draws it."""
    draws = " OR ".join(f"((i - {a}) * (i - {a}) + (j - {b}) * (j - {b}) <= {r * r} AND {uniform_sql(d, seed + 10 + n, 'i', 'j')} < {num(density)})" for n, (a, b, r) in enumerate(discs(rows, cols, seed)))
    return f"SELECT cast(i as int) AS {d.q('row')}, cast(j as int) AS {d.q('col')}, cell_id, ({draws}) AS is_agent FROM {cells_sql(d, rows, cols)} AS c"


def checked_mask(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """A given mask, if it has each cell of the grid once."""
    n, different, inside = mask.agg(F.count("*"), F.count_distinct("row", "col"), F.count_if(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))).first()
    if not n == different == inside == rows * cols:
        raise ValueError(f"the mask doesn't have the {rows} x {cols} cells of the grid")
    return mask


KINDS = ("PORE", "MINERAL", "ORGANIC")


def soil_sql(d: Dialect, rows: int, cols: int, seed: int = SEED) -> str:
    kind = f"CASE {bits_sql(d, seed, 'i', 'j')} % 3 WHEN 0 THEN '{KINDS[0]}' WHEN 1 THEN '{KINDS[1]}' ELSE '{KINDS[2]}' END"
    return f"SELECT cast(i as int) AS {d.q('row')}, cast(j as int) AS {d.q('col')}, cell_id, {kind} AS cell_type FROM {cells_sql(d, rows, cols)} AS c"


def nematodes(soil: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """As ``nematodes_sql``, with the pores numbered by a range sort; the entities (``count``, a parameter) are broadcast."""
    pores = ranked(soil.where("cell_type = 'PORE'").select("row", "col", "cell_id"), [F.col("cell_id")], "nr")
    n = pores.count()
    if not n:
        return pores.select(F.col("nr").alias("entity_id"), "row", "col").limit(0)
    entities = soil.sparkSession.range(count).selectExpr("id AS entity_id", f"{bits_sql(SPARK, seed, 'id')} % {n} AS nr")
    return pores.join(F.broadcast(entities), "nr").select("entity_id", "row", "col")


def nematodes_sql(d: Dialect, soil: str, count: int, seed: int = SEED) -> str:
    """count entities on pores, drawn with replacement from the pores in the order of cells; none where there is no pore."""
    pores = f"(SELECT {d.q('row')}, {d.q('col')}, row_number() OVER (ORDER BY cell_id) - 1 AS nr, count(*) OVER () AS pores FROM ({soil}) AS s WHERE cell_type = 'PORE')"
    return f"SELECT k AS entity_id, {d.q('row')}, {d.q('col')} FROM {d.numbers(count, 'k')} AS e JOIN {pores} AS p ON nr = {bits_sql(d, seed, 'k')} % pores"
