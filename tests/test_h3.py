"""H3 cells against published ids and their own geometry; cells of polygons and points in polygons against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellreach.functions import geo, h3
from cellreach.operators import polygons

# Published pairs of place, resolution and id.
KNOWN = [
    (37.7752702151959257, -122.418307270836565, 9, "8928308280fffff"),
    (37.3615593, -122.0553238, 5, "85283473fffffff"),
    (37.3615593, -122.0553238, 7, "87283472bffffff"),
]
RING = [(37.271355866731895, -121.91508032705622), (37.353926450852256, -121.86222328902491), (37.42834118609435, -121.9235499963016), (37.42012867767778, -122.0377349642703), (37.33755608435298, -122.09042892904395), (37.26319797461824, -122.02910130919)]


def places(n, seed=1):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    return np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(p[:, 2]))


def pentagon_places(res, seed=2):
    g, r = h3.grid(), np.random.default_rng(seed)
    middle = g.on_sphere(g.home, h3.axial(g.home_at))[g.pentagon]
    p = (middle[:, None] + r.normal(size=(12, 500, 3)) * r.uniform(0, 2, (12, 500, 1)) / 7 ** (res / 2)).reshape(-1, 3)
    p /= np.linalg.norm(p, axis=1)[:, None]
    return np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(p[:, 2]))


def test_published_ids():
    for lat, lon, res, want in KNOWN:
        assert format(int(h3.cells(np.array([lon]), np.array([lat]), res)[0]), "x") == want
    cell = np.array([int("85283473fffffff", 16)])
    assert np.allclose(np.ravel(h3.centres(cell)), [-121.976375972551, 37.345793375368], atol=1e-9)
    ring = h3.boundaries(cell)[0]
    assert np.allclose(ring[:-1, ::-1], RING, atol=1e-9) and (ring[0] == ring[-1]).all()


def test_base_cells_go_from_north_to_south():
    lat = h3.centres(h3.base_cells())[1]
    assert (np.diff(lat) < 1e-9).all() and h3.grid().pentagon.sum() == 12
    assert np.flatnonzero(h3.grid().pentagon).tolist() == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]


@pytest.mark.parametrize("res", range(16))
def test_round_trip(res):
    for lon, lat in (places(5000), pentagon_places(res)):
        ids = h3.cells(lon, lat, res)
        assert h3.is_cell(ids).all()
        x, y = h3.centres(ids)
        assert (h3.cells(x, y, res) == ids).all()
        if res:  # a cell's middle is in its parent
            parents = (ids & ~(15 << 52)) | ((res - 1) << 52) | (7 << 3 * (15 - res))
            assert (h3.cells(x, y, res - 1) == parents).all()


@pytest.mark.parametrize("res", range(4))
def test_boundaries_tile_the_sphere(res):
    ids, _ = h3.children(h3.base_cells(), res)
    assert len(ids) == 2 + 120 * 7**res and len(np.unique(ids)) == len(ids)
    total = 0.0
    for ring in h3.boundaries(ids):
        p = h3.xyz(np.radians(ring[:, 0]), np.radians(ring[:, 1]))
        c = p[:-1].mean(0) / np.linalg.norm(p[:-1].mean(0))
        a, b = p[:-1], p[1:]
        total += (2 * np.arctan2(np.cross(a, b) @ c, 1 + (a * b).sum(1) + b @ c + a @ c)).sum()
    assert abs(total / (4 * np.pi) - 1) < 1e-12


def test_points_are_within_their_boundaries():
    for res in (1, 4, 7):
        lon, lat = places(2000, 5)
        for x, y, ring in zip(lon, lat, h3.boundaries(h3.cells(lon, lat, res)), strict=True):
            p, v = h3.xyz(np.radians(x), np.radians(y)), h3.xyz(np.radians(ring[:, 0]), np.radians(ring[:, 1]))
            # Angles of the corners about the point add up to a whole turn (rings with crossings need not be convex).
            away = v - p * (v @ p)[:, None]
            turn = np.arctan2(np.cross(away[:-1], away[1:]) @ p, (away[:-1] * away[1:]).sum(1))
            assert abs(turn.sum() - 2 * np.pi) < 1e-6


def test_columns(spark):
    rows = [(37.7752702151959257, -122.418307270836565), (None, 1.0), (float("nan"), 1.0), (91.0, 0.0), (0.0, float("inf")), (-90.0, 0.0), (90.0, 180.0), (0.0, 540.0)]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("cell", h3.h3_cell(F.col("lon"), F.col("lat"), 9))
    got = df.withColumns({"text": geo.h3_string(F.col("cell")), "ring": h3.h3_boundary(F.col("cell")), "lon2": h3.h3_centre(F.col("cell"))[0]}).collect()
    assert [r["cell"] is None for r in got] == [False, True, True, True, True, False, False, False]
    assert got[0]["text"] == "8928308280fffff" and len(got[0]["ring"]) == 7 and got[1]["ring"] is None and got[1]["lon2"] is None
    assert abs(got[0]["lon2"] + 122.4183) < 0.01
    odd = spark.createDataFrame([(0,), (-1,), (None,), (int("8928308280fffff", 16) | 7 << 42,)], "cell long")
    assert all(r[0] is None and r[1] is None for r in odd.select(h3.h3_boundary(F.col("cell")), h3.h3_centre(F.col("cell"))[1]).collect())


def star(x, y, r, n, seed):
    g = np.random.default_rng(seed)
    a, d = np.linspace(0, 2 * np.pi, n, endpoint=False), r * g.uniform(0.3, 1, n)
    return [(float(x + d * np.cos(t)), float(y + d * np.sin(t))) for t, d in zip(a, d, strict=True)]


SHAPES = [
    ("star", [star(-71, 42, 9, 60, 1)]),
    ("holed", [[(-10, -10), (30, -10), (30, 25), (-10, 25)], star(8, 5, 9, 25, 2)]),
    ("parts", [star(100, 10, 6, 12, 3)]),
    ("parts", [star(103, 12, 6, 12, 4)]),
    ("parts", None),
    ("edge", [[(172, -20), (180, -20), (180, 20), (172, 20)]]),
    ("east", [[(176, 50), (187, 50), (187, 60), (176, 58)]]),
    ("pole", [[(-180, 80), (180, 80), (180, 90), (-180, 90)]]),
    ("thin", [[(20, 40), (60, 40.02), (20, 40.04)]]),
    ("tiny", [[(5.0, 5.0), (5.0001, 5.0), (5.0, 5.0001)]]),
    (None, [[(1, 50), (9, 50), (9, 55), (1, 55), (1, 50)], [], [(0, 0), (1, 1)]]),
]


def ring_rows():
    as_struct = lambda rings: rings and [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    return [(k, as_struct(r)) for k, r in SHAPES]


def inside(lon, lat):
    """(shape, position) of the places that each shape holds, by ray casting over all its sides."""
    out = set()
    for key, rings in SHAPES:
        odd = np.zeros(len(lon), bool)
        for ring in rings or []:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                if len(ring) > 2 and y1 != y2:
                    over = (y1 > lat) != (y2 > lat)
                    odd ^= over & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
        out |= {(key, int(k)) for k in np.flatnonzero(odd)}
    return out


SCHEMA = "poly string, rings array<array<struct<x: double, y: double>>>"


@pytest.mark.parametrize("res", [0, 2, 4])
def test_h3_polyfill(spark, res):
    ids, _ = h3.children(h3.base_cells(), res)
    lon, lat = h3.centres(ids)
    want = {(k, int(ids[n])) for k, n in inside(lon, lat)}
    got = polygons.h3_polyfill(spark.createDataFrame(ring_rows(), SCHEMA), res).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want


@pytest.mark.parametrize("spread", [1, 512])
def test_square_polyfill_and_cover(spark, monkeypatch, spread):
    monkeypatch.setattr(polygons, "SPREAD", spread)
    df = spark.createDataFrame(ring_rows(), SCHEMA)
    side = 360 / (1 << 4 + 4)
    x, y = np.meshgrid(np.arange(256), np.arange(128), indexing="ij")
    ids = (4 << 56) + (x.ravel().astype(np.int64) << 28) + y.ravel()
    want = {(k, int(ids[n])) for k, n in inside((x.ravel() + 0.5) * side - 180, (y.ravel() + 0.5) * side - 90)}
    assert set(map(tuple, polygons.polyfill(df, 4).collect())) == want
    rows = polygons.cover(df, polygons.SquareGrid(), 4).collect()
    assert {(r["poly"], r["cell"]) for r in rows if r["inside"]} == want
    assert all(r["inside"] and not r["edges"] for r in rows if r["whole"]) and any(r["whole"] for r in rows)


@pytest.mark.parametrize("res", [1, 5])
def test_points_in(spark, res):
    lon, lat = places(4000, 9)
    near = np.random.default_rng(4).uniform(-1, 1, (3000, 2)) * [12, 9] + [-71, 42]
    lon, lat = np.concatenate([lon, near[:, 0], [5.00001]]), np.concatenate([lat, near[:, 1], [5.00001]])
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lon, lat, strict=True))]
    points = spark.createDataFrame(rows + [rows[0], rows[0], (-1, None, 3.0)], "id long, lon double, lat double")
    got = [(r["poly"], r["id"]) for r in polygons.points_in(points, spark.createDataFrame(ring_rows(), SCHEMA), res).collect()]
    want = inside(lon, lat)
    assert set(got) == want and len(got) == len(want) + 2 * sum(n == 0 for _, n in want)


def test_many_corners(spark):
    """A ring of 10,000 corners: few edges a row, whole cells without any."""
    ring = star(-71, 42, 3, 10_000, 6)
    df = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ring]])], "poly int, rings array<array<struct<x: double, y: double>>>")
    rows = polygons.cover(df, polygons.SquareGrid(), 11).select("cell", "whole", "inside", F.size("edges").alias("n")).collect()
    assert len(rows) > 2000 and max(r["n"] for r in rows) < 10_000 * 4 / 5
    assert polygons.h3_polyfill(df, 6).count() > 1000


def test_no_polygons(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert polygons.h3_polyfill(none, 5).count() == 0 == polygons.polyfill(none, 5).count()
    points = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lon double, lat double")
    assert polygons.points_in(points, none, 4).count() == 0
