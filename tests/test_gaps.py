"""Stages, rings, states with modes, hover, and sinks and readers that no query exercises."""

import hashlib
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellreach.functions import geo, rings
from cellreach.operators import tables
from cellreach.plans import queries, standins
from cellreach.plans.livable import State, hover, livable_layers
from cellreach.plans.stages import Stage, run_stages
from cellreach.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_stages_build_what_changed(spark, tmp_path):
    built = []

    def stage(name, f, **more):
        def build(session, given):
            built.append(name)
            return f(session, given)

        return Stage(name, build, **more)

    for name, rows in (("a", [(1, "x"), (2, "y")]), ("b", [(1, 5)])):
        spark.createDataFrame(rows, "id int, v string" if name == "a" else "id int, n int").write.parquet(f"{tmp_path}/{name}")
    graph = lambda version="": [
        stage("joined", lambda s, t: t["left"].join(t["right"], "id"), needs=("left", "right")),
        stage("left", lambda s, t: s.read.parquet(f"{tmp_path}/a").where("id = 1"), sources=(f"{tmp_path}/a",), version=version),
        stage("right", lambda s, t: s.read.parquet(f"{tmp_path}/b"), sources=(f"{tmp_path}/b",)),
        stage("count", lambda s, t: t["right"].groupBy().count(), needs=("right",)),
    ]
    run = lambda version="": run_stages(spark, f"{tmp_path}/out", graph(version))
    assert set(run()) == {"left", "right", "joined", "count"} == set(built)
    assert run() == [] and len(built) == 4
    time.sleep(1.1)
    spark.createDataFrame([(1, 7)], "id int, n int").write.mode("overwrite").parquet(f"{tmp_path}/b")
    assert set(run()) == {"right", "joined", "count"}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/joined/table").collect()] == [(1, "x", 7)]
    # A source that changed without changing the stage's table reruns that stage alone.
    spark.createDataFrame([(1, "x"), (3, "z")], "id int, v string").write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert run() == ["left"]
    assert run("2") == ["left"]
    with pytest.raises(FileNotFoundError):
        run_stages(spark, f"{tmp_path}/out", [stage("x", lambda s, t: s.range(1), sources=(f"{tmp_path}/none",))])
    # A table without its manifest was left half written.
    os.rename(f"{tmp_path}/out/right/manifest", f"{tmp_path}/gone")
    assert run("2") == ["right"]


def even_odd(shape, x, y):
    odd = np.zeros(len(x), bool)
    for ring in shape:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


SHAPES = {
    "bow": [[(0, 0), (4, 4), (4, 0), (0, 4)]],
    "star": [[(0, 3), (6, 3), (1, 7), (3, 0), (5, 7)]],
    "hole": [[(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (6, 2), (6, 6), (2, 6)], [(3, 3), (5, 3), (5, 5), (3, 5)]],
    "thin": [[(0, 0), (9, 0.001), (0, 0.002)]],
    "touch": [[(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)]],
    "spike": [[(0, 0), (4, 0), (4, 4), (4, 7), (4, 4), (0, 4)]],
    "twice": [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4)]],
}


def test_valid_rings():
    r = np.random.default_rng(3)
    shapes = dict(SHAPES)
    for k in range(25):
        shapes[f"random{k}"] = [[tuple(p) for p in r.uniform(0, 9, (r.integers(4, 14), 2)).tolist()]]
    x, y = r.uniform(-1, 10, (2, 4000))
    for name, shape in shapes.items():
        made = rings.valid(rings.corners_of([[{"x": a, "y": b} for a, b in ring] for ring in shape]))
        closed = [[tuple(p) for p in ring.tolist()] for ring in made]
        assert all(ring[0] == ring[-1] and len(set(ring[:-1])) == len(ring) - 1 for ring in closed), name
        sides = np.array([(*p, *q) for ring in closed for p, q in zip(ring, ring[1:], strict=False)])
        assert not made or all(1e-9 > min(t, 1 - t) for cuts in rings._cuts(sides) for t, *_ in cuts), name  # they meet at corners alone
        flat = [ring[:-1] for ring in closed]
        assert (even_odd(flat, x, y) == even_odd(shape, x, y)).mean() > 0.9995, name
        signed = sum(rings._area(np.array(ring)) for ring in flat)
        assert signed > 0 or not made
        assert abs(signed / 121 - even_odd(shape, x, y).mean()) < 0.03, name
        inside = rings.scan_point(rings.corners_of([[{"x": a, "y": b} for a, b in ring] for ring in shape]))
        if name != "twice":
            assert even_odd(shape, np.array([inside[0]]), np.array([inside[1]])).all(), name
    assert rings.valid([]) == [] and rings.scan_point([]) is None


def test_ring_columns(spark):
    as_struct = lambda shape: [[{"x": float(a), "y": float(b)} for a, b in ring] for ring in shape]
    rows = [("bow", as_struct(SHAPES["bow"])), ("none", None), ("line", [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]]), ("empty", [])]
    df = spark.createDataFrame(rows, f"id string, rings {rings.RINGS}")
    x, y = rings.representative_point(F.col("rings"))
    got = {r["id"]: r for r in df.select("id", rings.make_valid(F.col("rings")).alias("valid"), x.alias("x"), y.alias("y")).collect()}
    assert len(got["bow"]["valid"]) == 2 and got["bow"]["x"] is not None
    assert all(got[k]["valid"] is None and got[k]["x"] is None for k in ("none", "line", "empty"))
    shapes = spark.createDataFrame(
        [(1, "way", {"natural": "beach"}, None, None, as_struct(SHAPES["hole"])), (2, "way", {"natural": "beach"}, None, None, None), (3, "node", {"natural": "beach"}, 5.0, 6.0, None)],
        f"id int, kind string, tags map<string,string>, lon double, lat double, rings {rings.RINGS}",
    )
    found = {r["id"]: (r["lon"], r["lat"]) for r in readers.beaches(shapes).collect()}
    assert set(found) == {1, 3} and even_odd(SHAPES["hole"], *np.array([found[1]]).T).all()
    ring = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 0.0, "y": 6.0}, {"x": 0.0, "y": 0.0}],)], "ring array<struct<x: double, y: double>>")
    assert tuple(ring.select(*geo.ring_centroid(F.col("ring"))).first()) == (1.0, 2.0)


def test_layers_and_hover(spark):
    cells = spark.createDataFrame([(1, "Mild", 700, 10, 400, False), (2, None, None, None, None, True)], "cell int, climate_label string, temp_mean_summer_f_q int, temp_mean_jan_f_q int, ppt_jan_in_q int, near_power_corridor boolean")
    ranked = spark.createDataFrame([("drive", 1, 9, 60), ("drive", 2, 9, 600), ("walk", 1, 9, 900)], "mode string, cell int, anchor int, t int")
    legs = spark.createDataFrame([("drive", 9, "cafe", 30), ("walk", 9, "park", 100)], "mode string, anchor int, entity string, seconds int")
    got = lambda **kw: {tuple(r) for r in livable_layers(cells, ranked, legs, State(**kw)).collect()}
    assert got(wanted={"cafe": 5}) == {("drive", 1)} and got(wanted={"cafe": None}) == {("drive", 1), ("drive", 2)}
    assert got(wanted={"cafe": 5, "park": 17}, modes={"park": "walk"}) == {("drive", 1), ("walk", 1)}
    assert got(wanted={"cafe": 5}, modes={"cafe": "walk"}) == {("drive", 1), ("drive", 2)} == got()
    assert got(avoid_power_lines=True) == {("drive", 1), ("walk", 1)}
    drive = ranked.where("mode = 'drive'"), legs.where("mode = 'drive'")
    rows = {r["cell"]: r for r in hover(cells, *drive, ["cafe"], ["jan"]).collect()}
    assert rows[1]["label"] == "Mild" and rows[1]["summer"] == 70.0 and rows[1]["temps"] == [1.0] and rows[1]["rains"] == [40.0] and rows[1]["winter"] is None
    assert rows[2]["temps"] is None and rows[1]["minutes"] == {"cafe": 2} and rows[2]["minutes"] == {"cafe": 11}


def test_wider_types():
    pick = lambda a, b: tables.wider(T._parse_datatype_string(a), T._parse_datatype_string(b)).simpleString()  # noqa: E731, SLF001
    cases = [("tinyint", "bigint", "bigint"), ("int", "float", "double"), ("smallint", "float", "float"), ("float", "double", "double"), ("date", "timestamp", "timestamp"),
             ("int", "string", "string"), ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("array<int>", "array<bigint>", "array<bigint>"), ("boolean", "int", "string")]
    for a, b, want in cases:
        assert pick(a, b) == want == pick(b, a)
    with pytest.raises(TypeError):
        pick("array<int>", "string")


def test_facilities_of_documents_and_lines(spark, tmp_path):
    place = lambda x: {"latitude": 1.0, "longitude": x}
    row = lambda name, guid, x: {"name": name, "guid": guid, "country": "United States", "locationPoint": place(x), "programs": [{"levels": ["Level I Trauma Center"]}]}
    (tmp_path / "a.json").write_text(json.dumps({"results": [row("P", "first", 2.0000001), row("P", "again", 2.0), row("Q", "q", 3.0)]}))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(row(n, g, x)) for n, g, x in (("R", "r", 4.0), ("R", "later", 4.0))))
    got = {(r["name"], r["ext_id"]) for r in readers.read_facilities(spark, str(tmp_path), None).collect()}
    assert got == {("P", "first"), ("Q", "q"), ("R", "r")}
    assert {r["ext_id"] for r in readers.read_facilities(spark, f"{tmp_path}/b.json", None).collect()} == {"r"}


def test_edges_scales_and_pending(spark, tmp_path):
    raw = [(1, 2, 100.0, "residential", "36", "no"), (2, 3, 100.0, "residential", "36", "yes"), (3, 4, None, "primary", None, None)]
    spark.createDataFrame(raw, "u long, v long, length double, highway string, maxspeed string, oneway string").write.parquet(f"{tmp_path}/w")
    drive = {(r["u"], r["v"]): (r["w"], r["oneway"]) for r in readers.read_edges(spark, f"{tmp_path}/w").collect()}
    assert drive[1, 2] == (10, False) and drive[2, 3] == (10, True) and drive[3, 4][0] > 0
    assert {r["oneway"] for r in readers.read_edges(spark, f"{tmp_path}/w", "walk").collect()} == {False}
    scaled = sinks.with_scales(spark.createDataFrame([(1, 2)], "cell int, q int"), {"q": 0.1})
    scaled.write.parquet(f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").schema["q"].metadata == {"scale": 0.1}
    targets = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "entity string, fingerprint string")
    done = spark.createDataFrame([("a", "1"), ("b", "old")], "entity string, fingerprint string")
    assert {r["entity"] for r in sinks.pending(targets, done).collect()} == {"b", "c"}
    cells = spark.createDataFrame([(1, 7), (2, 8), (3, 8)], "cell int, res int")
    sinks.write_by_resolution(cells, f"{tmp_path}/c", [7, 8])
    assert {r["cell"] for r in spark.read.parquet(f"{tmp_path}/c/r8").collect()} == {2, 3} and spark.read.parquet(f"{tmp_path}/c/r7").columns == ["cell"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_fingerprint_and_features_by_brute_force(spark):
    df = standins.table(spark, SF, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    from cellreach.functions.ids import row_digest

    rows = [r[0] for r in df.select(row_digest(*[F.col(c) for c in df.columns])).collect()]
    sums = [sum(int(d[at : at + 8], 16) for d in rows) for at in (0, 8, 16, 24)]
    want = hashlib.sha256("|".join(map(str, [len(rows), *sums])).encode()).hexdigest()
    assert tuple(queries.fingerprint(spark, SF).first()) == (len(rows), want)
    shuffled = tables.fingerprint(df.orderBy(F.rand(3)).repartition(5), df.columns).first()
    assert tuple(shuffled) == (len(rows), want)
    assert tables.fingerprint(df.where("p_partkey > 1"), df.columns).first()["digest"] != want
    features = [json.loads(r["value"]) for r in queries.geojson_features(spark, SF).collect()]
    points = {r["id"]: (r["lon"], r["lat"]) for r in standins.points(spark, SF).collect()}
    side = 360 / (1 << 13)
    assert {f["properties"]["id"] for f in features} == set(points)
    for f in random.Random(1).sample(features, 40):
        x, y = points[f["properties"]["id"]]
        i, j = np.floor((x + 180) / side), np.floor((y + 90) / side)
        corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
        assert f["type"] == "Feature" and f["geometry"]["type"] == "Polygon"
        assert np.allclose(f["geometry"]["coordinates"], [[(a * side - 180, b * side - 90) for a, b in corners]])
        assert f["properties"]["cell"] == str((9 << 56) + (int(i) << 28) + int(j))
