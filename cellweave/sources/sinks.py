"""Results for drawing: colour numbers, plain-text pictures and PNG files. Tables themselves are written with Spark's own writers."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOURS = 45
#: Rows of a picture that are compressed in one task.
STRIP = 64
#: Fixed by the PNG format.
PNG_HEAD, ADLER = b"\x89PNG\r\n\x1a\n", 65521


def colour_index(assignment: DataFrame) -> DataFrame:
    return assignment.withColumn("color_index", F.abs(F.col("cluster_id") % COLOURS))


def picture_lines(assignment: DataFrame) -> DataFrame:
    """(row, line): a portable pixmap's lines, one a grid row; row -1 is its head. Open cells are white, hues go round by cluster."""
    turn = F.col("cluster_id") % COLOURS * 137 % 360
    part = lambda shift: F.round(F.lit(127.5) * (1 + F.cos((turn + shift) * F.lit(3.141592653589793 / 180)))).cast("int").cast("string")
    pixel = F.when(F.col("cluster_id").isNull(), "255 255 255").otherwise(F.concat_ws(" ", part(0), part(120), part(240)))
    body = assignment.withColumn("p", F.struct("col", pixel.alias("v"))).groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["v"]), "  ").alias("line"))
    head = assignment.agg(F.concat(F.lit("P3 "), F.max("col") + 1, F.lit(" "), F.max("row") + 1, F.lit(" 255")).alias("line"))
    return head.select(F.lit(-1).alias("row"), "line").unionByName(body)


def write_lines(lines: DataFrame, path: str, order: str) -> None:
    """Write ordered text in one file; for pictures and graph texts of a size to look at."""
    lines.orderBy(order).select("line").coalesce(1).write.text(path)


def _rgb(cluster: Column) -> Column:
    """A colour as 0xRRGGBB: hues go round by cluster; null is white."""
    turn = cluster % COLOURS * 137 % 360
    part = lambda shift: F.round(F.lit(127.5) * (1 + F.cos((turn + shift) * F.lit(3.141592653589793 / 180)))).cast("int")
    return F.coalesce(part(0) * 65536 + part(120) * 256 + part(240), F.lit(0xFFFFFF))


def cluster_pixels(assignment: DataFrame) -> DataFrame:
    """(row, col, rgb) of a grid's clusters; open cells are white."""
    return assignment.select("row", "col", _rgb(F.col("cluster_id")).alias("rgb"))


def weight_pixels(cells: DataFrame, weight: str) -> DataFrame:
    """(row, col, rgb) in grey, the heaviest cell black; null weights are white."""
    top = cells.agg(F.max(weight).alias("_top"))
    grey = F.lit(255) - F.coalesce(F.round(F.try_divide(F.col(weight) * 255, F.col("_top"))), F.lit(0)).cast("int")
    return cells.crossJoin(F.broadcast(top)).select("row", "col", (grey * 65793).alias("rgb"))  # top is one row


def _scaled(points: DataFrame, size: int) -> DataFrame:
    """points with col and row from 0 to size - 1, one scale for x and y."""
    box = points.agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-12)).alias("_w"))
    place = lambda c: F.round((F.col(c) - F.col(f"_{c}")) / F.col("_w") * (size - 1)).cast("bigint")
    return points.crossJoin(F.broadcast(box)).withColumns({"col": place("x"), "row": place("y")})  # box is one row


def point_pixels(points: DataFrame, size: int) -> DataFrame:
    """(row, col, rgb) of points (x, y, cluster_id) on size x size; of points on one pixel the lowest cluster shows."""
    return cluster_pixels(_scaled(points, size).groupBy("row", "col").agg(F.min("cluster_id").alias("cluster_id")))


def graph_pixels(vertices: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(row, col, rgb): edges (src, dst) as grey lines, and vertices (id, x, y, cluster_id) over them."""
    at = _scaled(vertices, size)
    ends = (at.select(F.col("id").alias(c), F.col("row").alias(f"r_{c}"), F.col("col").alias(f"c_{c}")) for c in ("src", "dst"))
    lines = edges
    for end, c in zip(ends, ("src", "dst"), strict=True):
        lines = lines.join(end, c)
    steps = F.greatest(F.abs(F.col("r_dst") - F.col("r_src")), F.abs(F.col("c_dst") - F.col("c_src")), F.lit(1))
    lines = lines.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), "_n")))
    way = lambda a: F.round(F.col(f"{a}_src") + (F.col(f"{a}_dst") - F.col(f"{a}_src")) * F.col("_i") / F.col("_n")).cast("bigint")
    grey = lines.select(way("r").alias("row"), way("c").alias("col")).distinct().withColumn("rgb", F.lit(0xA0A0A0))
    dots = point_pixels(vertices, size)
    return grey.join(dots, ["row", "col"], "left_anti").unionByName(dots)


def beside(left: DataFrame, right: DataFrame, gap: int = 4) -> DataFrame:
    """Two pictures in one, right of each other."""
    wide = left.agg((F.max("col") + 1 + gap).alias("_wide"))
    return left.unionByName(right.crossJoin(F.broadcast(wide)).select("row", (F.col("col") + F.col("_wide")).alias("col"), "rgb"))  # wide is one row


def png_strips(pixels: DataFrame) -> DataFrame:
    """(strip, width, height, size, adler, data): a picture's rows, STRIP at a time, as deflated PNG scan lines in hexadecimal.

    Places without a pixel are white, of several pixels of one place the least
    shows, null places are left out; an empty table gives no strip.
    """
    pixels = pixels.where("row IS NOT NULL AND col IS NOT NULL")
    wide, high = pixels.agg(F.max("col") + 1, F.max("row") + 1).first()
    spark, schema = pixels.sparkSession, "strip bigint, width bigint, height bigint, size bigint, adler bigint, data string"
    if wide is None:
        return spark.createDataFrame([], schema)

    def squeeze(key, frame):
        import numpy as np
        import pandas as pd

        first, frame = int(key[0]) * STRIP, frame.dropna().sort_values("rgb", ascending=False)
        image = np.full((min(STRIP, high - first), wide, 3), 255, np.uint8)
        rgb = frame["rgb"].to_numpy(np.int64)
        image[frame["row"].to_numpy(np.int64) - first, frame["col"].to_numpy(np.int64)] = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], 1)
        lines = b"".join(b"\0" + line.tobytes() for line in image)
        pack = zlib.compressobj(9, zlib.DEFLATED, -15)
        data = pack.compress(lines) + pack.flush(zlib.Z_FULL_FLUSH)
        return pd.DataFrame([(int(key[0]), wide, high, len(lines), zlib.adler32(lines), data.hex())], columns=["strip", "width", "height", "size", "adler", "data"])

    least = pixels.groupBy("row", "col").agg(F.min("rgb").alias("rgb"))
    # A row of nulls for each strip, so that empty ones come out too.
    every = spark.range(-(-high // STRIP)).select((F.col("id") * STRIP).alias("row"), F.lit(None).cast("bigint").alias("col"), F.lit(None).cast("int").alias("rgb"))
    rows = least.select(F.col("row").cast("bigint"), F.col("col").cast("bigint"), F.col("rgb").cast("int")).unionByName(every)
    return rows.groupBy(F.floor(F.col("row") / STRIP).alias("strip")).applyInPandas(squeeze, schema)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(strips: DataFrame, path: str) -> None:
    """One PNG file at a path of Spark's file systems; the driver holds a partition of strips at a time. Without strips no file is written."""
    spark, out, one, two = strips.sparkSession, None, 1, 0
    for r in strips.orderBy("strip").toLocalIterator():
        start = b""
        if out is None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
            out.write(bytearray(PNG_HEAD + _chunk(b"IHDR", struct.pack(">IIBBBBB", r["width"], r["height"], 8, 2, 0, 0, 0))))
            start = b"\x78\xda"
        out.write(bytearray(_chunk(b"IDAT", start + bytes.fromhex(r["data"]))))
        # The checksum of joined parts from those of the parts.
        a, b = r["adler"] & 0xFFFF, r["adler"] >> 16
        two = (two + b + r["size"] * (one - 1)) % ADLER
        one = (one + a - 1) % ADLER
    if out is not None:
        out.write(bytearray(_chunk(b"IDAT", b"\x03\0" + struct.pack(">I", two << 16 | one)) + _chunk(b"IEND", b"")))
        out.close()
