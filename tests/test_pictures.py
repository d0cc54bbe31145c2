"""PNG files against their pixels."""

import struct
import zlib

from cellweave.plans import queries
from cellweave.sources import sinks


def decoded(path):
    raw = open(path, "rb").read()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, []
    while at < len(raw):
        (size,) = struct.unpack(">I", raw[at : at + 4])
        kind, data = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + size]
        assert struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0] == zlib.crc32(kind + data)
        parts.append((kind, data))
        at += 12 + size
    assert parts[-1][0] == b"IEND"
    wide, high = struct.unpack(">II", parts[0][1][:8])
    lines = zlib.decompress(b"".join(d for k, d in parts if k == b"IDAT"))
    assert len(lines) == high * (3 * wide + 1)
    return wide, high, lambda r, c: int.from_bytes(lines[r * (3 * wide + 1) + 1 + 3 * c :][:3], "big")


def test_png_round_trip(spark, tmp_path):
    rows = [(r, c, (r * 7919 + c * 104729) % 0x1000000) for r in range(150) for c in range(37) if (r + c) % 5 and r // 64 != 1]
    more = [(3, 3, 5), (None, 1, 1), (1, None, 1)]
    df = spark.createDataFrame([*rows, *more], "row int, col int, rgb int")
    sinks.write_png(sinks.png_strips(df), str(tmp_path / "a.png"))
    wide, high, at = decoded(tmp_path / "a.png")
    want = {(r, c): v for r, c, v in rows} | {(3, 3): 5}
    assert (wide, high) == (37, 150)
    assert all(at(r, c) == want.get((r, c), 0xFFFFFF) for r in range(150) for c in range(37))


def test_pictures(spark, tmp_path):
    clusters = sinks.cluster_pixels(spark.createDataFrame([(0, 0, 1), (0, 1, None)], "row int, col int, cluster_id int"))
    weights = sinks.weight_pixels(spark.createDataFrame([(0, 0, 4.0), (0, 1, 0.0), (1, 0, None)], "row int, col int, w double"), "w")
    sinks.write_png(sinks.png_strips(sinks.beside(clusters, weights, 1)), str(tmp_path / "b.png"))
    wide, high, at = decoded(tmp_path / "b.png")
    assert (wide, high) == (5, 2)
    assert [at(0, c) for c in range(5)][1:] == [0xFFFFFF, 0xFFFFFF, 0, 0xFFFFFF] and at(0, 0) != 0xFFFFFF and at(1, 3) == 0xFFFFFF
    points = spark.createDataFrame([(0, 0.0, 0.0, 3), (1, 9.0, 0.0, 4), (2, 9.0, 0.0, 2)], "id long, x double, y double, cluster_id long")
    edges = spark.createDataFrame([(0, 1)], "src long, dst long")
    drawn = {(r.row, r.col): r.rgb for r in sinks.graph_pixels(points, edges, 10).collect()}
    assert set(drawn) == {(0, c) for c in range(10)} and drawn[0, 5] == 0xA0A0A0 and drawn[0, 9] != 0xA0A0A0
    assert sinks.png_strips(clusters.where("row < 0")).count() == 0


def test_picture_queries(spark):
    for name in ("cluster_png", "events_png", "points_png", "graph_png"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
