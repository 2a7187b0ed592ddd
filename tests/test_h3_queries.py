"""The registered H3 queries against H3 by brute force on the same rows."""

import os

import numpy as np
import pytest

from cellreach.functions import h3
from cellreach.plans import queries, standins

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_cells_and_boundaries(spark):
    points = {r["id"]: (r["lon"], r["lat"]) for r in standins.points(spark, SF).select("id", "lon", "lat").collect()}
    rows = queries.h3_cells(spark, SF).collect()
    assert {r["id"] for r in rows} == set(points)
    for res in (7, 8, 9, 11):
        want = h3.cells(*np.array([points[r["id"]] for r in rows]).T, res)
        assert [r[f"r{res}"] for r in rows] == [format(int(c), "x") for c in want]
        x, y = h3.centres(np.array([int(r["r11"], 16) for r in rows]))
        if res < 11:
            # The parent by id holds the middle of the fine cell's parent chain; nearly always the point's own coarse cell.
            assert np.mean([r[f"r{res}"] == r[f"up{res}"] for r in rows]) > 0.85
    shown = queries.h3_boundaries(spark, SF).collect()
    assert {format(r["cell"], "x") for r in shown} == {r["r8"] for r in rows}
    for r in shown:
        assert np.allclose(r["ring"], h3.boundaries(np.array([r["cell"]]))[0]) and len(r["ring"]) == 7


def test_polygon_cells(spark):
    shapes = [(r["poly"], [(p["x"], p["y"]) for p in r["ring"]]) for r in queries._polygons(spark, SF).collect()]
    got = {tuple(r) for r in queries.h3_polygon_cells(spark, SF).collect()}
    lon, lat = np.meshgrid(np.arange(-74, -69, 0.004), np.arange(41, 43.6, 0.004))
    ids = np.unique(h3.cells(lon.ravel(), lat.ravel(), 7))
    x, y = h3.centres(ids)
    want = set()
    for poly, ring in shapes:
        odd = np.zeros(len(ids), bool)
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        want |= {(poly, int(c)) for c in ids[odd]}
    assert got == want
    cells = queries.county_cells(spark, SF).collect()
    assert len({r["cell"] for r in cells}) == len(cells) and all(0 < r["share"] <= 1 and 0 <= r["rep_share"] <= 1 for r in cells)


def test_conflation_and_features(spark):
    import json

    pois = standins.pois(spark, SF).collect()
    place = np.array([(r["lon"], r["lat"]) for r in pois])
    cell = {res: h3.cells(*place.T, res) for res in (8, 9, 10, 11)}
    best = {}
    for k, r in enumerate(pois):
        branded = r["brand_id"] is not None
        key = (r["brand_id"] or "", r["name"].strip().lower(), (r["category"] or "").strip().lower(), int(cell[11 if branded else 10][k]))
        rank = (not branded, {"overture": 0, "osm": 1}.get(r["source"], 2), r["poi_id"])
        best[key] = min(best.get(key, (rank, k)), (rank, k))
    want = {(pois[k]["poi_id"], format(int(cell[9][k]), "x")) for _, k in best.values()}
    got = queries.conflate_h3(spark, SF).collect()
    assert {(r["poi_id"], r["h3_r9"]) for r in got} == want and len(got) == len(want) < len(pois)
    features = [json.loads(r["value"]) for r in queries.h3_features(spark, SF).collect()]
    points = standins.points(spark, SF).count()
    assert sum(f["properties"]["n"] for f in features) == points
    ids = np.array([int(f["properties"]["cell"], 16) for f in features])
    for f, ring in zip(features, h3.boundaries(ids), strict=True):
        assert np.allclose(f["geometry"]["coordinates"][0], ring)
