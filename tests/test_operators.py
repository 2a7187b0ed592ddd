import heapq
import random

from pyspark.sql import functions as F

from cellreach.operators import checks, graph, poi, spatial, tables, times
from cellreach.plans.livable import State, livable
from cellreach.sources import readers, sinks

GRAPH5 = [(1, 2, 5), (2, 3, 5), (1, 3, 20), (3, 4, 7), (4, 1, 3), (4, 5, 2), (5, 4, 2)]


def brute_kbest(edges, sources, k, cutoff):
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
    labels = {}
    for s in set(sources):
        best, heap = {s: 0}, [(0, s)]
        while heap:
            d, n = heapq.heappop(heap)
            if d > best[n]:
                continue
            for v, w in near.get(n, ()):
                if d + w <= cutoff and d + w < best.get(v, 1 << 60):
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        for n, d in best.items():
            labels.setdefault(n, []).append((d, s))
    return {(n, s, d) for n, x in labels.items() for d, s in sorted(x)[:k]}


def test_kbest_hand_graph(spark):
    edges = spark.createDataFrame(GRAPH5, "u long, v long, w long")
    sources = spark.createDataFrame([(1,), (4,)], "node long")
    got = {tuple(r) for r in graph.kbest(edges, sources, 2, 15).select("node", "src", "d").collect()}
    assert got == brute_kbest(GRAPH5, [1, 4], 2, 15)
    assert (5, 4, 2) in got and (3, 1, 10) in got and (1, 4, 3) in got


def test_kbest_strategies_agree(spark):
    r = random.Random(3)
    rows = [(r.randrange(40), r.randrange(40), r.randrange(0, 9)) for _ in range(160)]
    edges = spark.createDataFrame(rows, "u long, v long, w long")
    sources = spark.createDataFrame([(k,) for k in (0, 7, 11, 30, 7)], "node long")
    want = brute_kbest(rows, [0, 7, 11, 30], 3, 25)
    for strategy in (graph.kbest, graph.kbest_by_source):
        got = {tuple(x) for x in strategy(edges, sources, 3, 25).select("node", "src", "d").collect()}
        assert got == want


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert {got[k] for k in range(10, 41)} == {10} and got[101] == 100


def test_livable(spark):
    cells = spark.createDataFrame([(k,) for k in range(1, 7)], "cell long")
    ranked = spark.createDataFrame([(1, 1, 60), (2, 1, 600), (3, 2, 60), (4, 2, 900), (5, 3, 10), (6, 1, 60)], "cell long, anchor long, t long")
    legs = spark.createDataFrame([(1, "cafe", 60), (2, "cafe", 60), (1, "park", 30), (2, "park", 900)], "anchor long, entity string, seconds long")
    found = lambda **w: {r["cell"] for r in livable(cells, ranked, legs, State(w)).collect()}
    assert found() == {1, 2, 3, 4, 5, 6}
    assert found(cafe=5) == {1, 3, 6}
    assert found(cafe=5, park=5) == {1, 6}
    assert found(cafe=5, nothing=5) == {1, 3, 6}  # an entity that nobody can reach imposes nothing
    assert found(nothing=5) == {1, 2, 3, 4, 5, 6}


def test_state_keeps_the_specific_hospital():
    assert State({"hospital": 5, "trauma_level_1_adult": 9}).normalised().wanted == {"trauma_level_1_adult": 9}


def test_topk_ties_and_wide(spark):
    rows = [(1, 5, 10), (1, 5, 9), (1, 4, 9), (1, 3, 11), (2, 9, 1)]
    ranked = times.cell_topk(spark.createDataFrame(rows, "cell long, anchor long, t long"), 2)
    assert {tuple(r) for r in ranked.select("cell", "anchor", "rank").collect()} == {(1, 4, 0), (1, 5, 1), (2, 9, 0)}
    wide = {r["cell"]: r for r in times.widen(ranked, 2).collect()}
    assert (wide[1]["a1_id"], wide[1]["a1_s"], wide[2]["a1_id"]) == (5, 9, None)


def test_conform_and_legs_round_trip(spark, tmp_path):
    old = spark.createDataFrame([(7, 12), (8, 13)], "anchor_int_id int, seconds_u16 int").withColumns(
        {"mode": F.lit(0), "entity": F.lit("cafe"), "extra": F.lit(1)}
    )
    legs = tables.conform(old, readers.LEGS, readers.LEGACY)
    assert legs.columns == readers.LEGS.names
    base = str(tmp_path / "legs")
    sinks.write_legs(legs, base)
    sinks.write_legs(legs.withColumn("entity", F.lit("park")), base)
    assert readers.read_legs(spark, base, 0).count() == 4
    assert {r["anchor"] for r in readers.read_legs(spark, base, 0, "park").collect()} == {7, 8}


def test_registry_rejects_double_ids(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("category_id,numeric_id,display_name\na,1,A\nb,1,B\n")
    try:
        readers.read_registry(spark, str(path))
    except ValueError as e:
        assert "1" in str(e)
    else:
        raise AssertionError("accepted")


def test_facilities_inherit_places(spark, tmp_path):
    path = tmp_path / "f.json"
    path.write_text(
        '{"results": [{"name": "P", "guid": "p", "country": "US", "locationPoint": {"latitude": 1.5, "longitude": 2.5}, "programs": [],'
        ' "childInstitutions": [{"name": "C", "guid": "c", "country": "US", "locationPoint": null, "programs": [{"levels": ["Level I Trauma Center"]}]}]}]}'
    )
    assert [tuple(r) for r in readers.read_facilities(spark, str(path)).collect()] == [("C", "c", "adult", 2.5, 1.5)]


def test_conflation_prefers_branded_and_better_source(spark):
    rows = [("x", "Cafe", "cafe", "b", "osm", "1"), ("y", "cafe ", "CAFE", "b", "overture", "1"), ("z", "Other", "cafe", None, "osm", "2")]
    df = spark.createDataFrame(rows, "poi_id string, name string, category string, brand_id string, source string, ext_id string").withColumns(
        {"lon": F.lit(1.0), "lat": F.lit(2.0)}
    )
    assert {r["poi_id"] for r in poi.conflate(df).collect()} == {"y", "z"}


def test_point_on_far_side_is_not_near(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.001, 0.0)], "id long, lon double, lat double")
    places = spark.createDataFrame([(5, 0.0005, 0.0)], "place long, p_lon double, p_lat double")
    got = {(r["id"], round(r["dist"], 1)) for r in spatial.knn_join(points, places, 1, 100.0, 9).collect()}
    assert got == {(1, 55.5), (2, 55.5)}


def test_checks(spark):
    df = spark.createDataFrame([(1, 65535), (1, 10), (2, 20)], "k long, t int")
    assert [tuple(r) for r in checks.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert checks.sentinel_share(df, "t").first()["n_sentinel"] == 1
    assert checks.missing_columns(df, ["k", "z"]) == ["z"]


def test_upsert_and_fingerprint(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "path string, at int")
    new = spark.createDataFrame([("b", 2), ("c", 1)], "path string, at int")
    out = sinks.upsert_latest(old, new, "path", "at")
    assert [tuple(r) for r in out.collect()] == [("a", 1), ("b", 2), ("c", 1)]
    a, b = tables.fingerprint(out, ["path", "at"]).first(), tables.fingerprint(out.orderBy(F.desc("path")), ["path", "at"]).first()
    assert a == b
