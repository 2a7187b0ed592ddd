"""Readers, sinks and checks on small files, and the parted search on graphs of many hops."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from cellreach.functions import geo, text
from cellreach.operators import anchors, checks, graph, poi, spatial, tables
from cellreach.sources import readers, sinks
from tests.test_operators import brute_kbest


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_parted_search_agrees(spark, parts):
    r = random.Random(parts)
    rows = [(r.randrange(40), r.randrange(40), r.randrange(0, 9)) for _ in range(160)]
    edges = spark.createDataFrame(rows, "u long, v long, w long")
    sources = spark.createDataFrame([(k,) for k in (0, 7, 11, 30, 7, 99)], "node long")
    got = [tuple(x) for x in graph.kbest_by_part(edges, sources, 3, 25, parts=parts).select("node", "src", "d").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kbest(rows, [0, 7, 11, 30, 99], 3, 25)


def test_a_thousand_hops_take_few_rounds(spark):
    edges = spark.createDataFrame([(k, k + 1, 1) for k in range(1000)], "u long, v long, w long")
    got = graph.kbest_by_part(edges, spark.createDataFrame([(0,)], "node long"), 1, 5000, parts=4, max_rounds=8)
    assert {(r["node"], r["d"]) for r in got.collect()} == {(k, k) for k in range(1001)}


def test_parted_search_without_edges(spark):
    none = spark.createDataFrame([], "u long, v long, w long")
    got = graph.kbest_by_part(none, spark.createDataFrame([(5,)], "node long"), 2, 10)
    assert [tuple(r) for r in got.collect()] == [(5, 5, 0)]


def test_batch_of_entities(spark):
    edges = spark.createDataFrame([(1, 2, 60), (2, 3, 60), (3, 4, 600)], "u long, v long, w long")
    sites = spark.createDataFrame([(10, 1, ["cafe"]), (20, 3, ["park", "cafe"]), (30, 4, ["park"])], "anchor long, node long, categories array<string>")
    targets = spark.createDataFrame([("cafe", 5), ("park", 2), ("zoo", 9)], "entity string, max_minutes int")
    got = {tuple(r) for r in anchors.d_anchor_batch(edges, sites, targets).collect()}
    assert got == {(10, "cafe", 0), (20, "cafe", 0), (20, "park", 0), (30, "park", 0), (10, "park", 120)}


def test_far_points_and_long_segments(spark):
    points = spark.createDataFrame([(1, -71.0, 42.0), (2, -70.0, 42.0), (3, -60.0, 60.0)], "id long, lon double, lat double")
    places = spark.createDataFrame([(7, -70.5, 42.0)], "place long, p_lon double, p_lat double")
    assert {r["id"] for r in spatial.within(points, places, 60_000.0, 9).collect()} == {1, 2}  # cells far narrower than the distance
    assert {r["id"] for r in spatial.knn_any(points, places, 2, 500.0, 9).collect()} == {1, 2, 3}
    line = spark.createDataFrame([(-71.0, 42.0, -61.0, 58.0)], "ax double, ay double, bx double, by double")
    assert [r["near"] for r in spatial.near_segments(points, line, 1000.0, 5).orderBy("id").collect()] == [True, False, False]


def wkb(lon, lat):
    return struct.pack("<BIdd", 1, 1, lon, lat)


def test_wkb(spark):
    rows = [(1, wkb(-71.5, 42.25)), (2, None), (3, struct.pack("<BII", 1, 3, 0)), (4, b"\x00\x01"), (5, wkb(float("nan"), 1.0))]
    df = spark.createDataFrame(rows, "id int, g binary")
    lon, lat = geo.wkb_point(F.when(geo.wkb_kind(F.col("g")) == "Point", F.col("g")))
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", geo.wkb_kind(F.col("g")), geo.wkb_is_empty(F.col("g")), lon, lat).collect()}
    assert got[1] == ("Point", False, -71.5, 42.25) and got[2] == (None, None, None, None)
    assert got[3][:2] == ("Polygon", True) and got[4][0] is None and got[5][:2] == ("Point", True)


def test_read_places_and_water(spark, tmp_path):
    box = "struct<xmin: double, xmax: double, ymin: double, ymax: double>"
    ddl = f"id string, names struct<primary: string>, categories struct<primary: string>, brand struct<names: struct<primary: string>>, bbox {box}, geometry binary"
    rows = [("a", ("A",), ("cafe",), ((None,),), (-71.0, -71.0, 42.0, 42.0), wkb(-71.25, 42.5)), ("b", None, None, None, (0.0, 0.0, 0.0, 0.0), wkb(0.0, 0.0))]
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/p")
    got = readers.read_places(spark, f"{tmp_path}/p", (-70.0, 43.0, -72.0, 41.0)).collect()
    assert [(r["ext_id"], r["name"], r["lon"], r["lat"]) for r in got] == [("a", "A", -71.25, 42.5)]
    water = [("Lake", (0.0, 4.0, 0.0, 4.0)), ("spring", (0.0, 4.0, 0.0, 4.0)), ("sea", (9.0, 10.0, 0.0, 1.0)), ("lagoon", (1.0, 2.0, 1.0, 2.0))]
    spark.createDataFrame(water, f"subtype string, bbox {box}").write.parquet(f"{tmp_path}/w")
    got = {r["subtype"]: r["kind"] for r in readers.read_water(spark, f"{tmp_path}/w", (3.0, 3.0, 1.5, 1.5)).collect()}
    assert got == {"Lake": "lake", "lagoon": "other"}


def test_tagged_features(spark):
    ddl = "id long, kind string, tags map<string,string>, lon double, lat double"
    rows = [
        (1, "node", {"amenity": "cafe", "name": "A"}, 1.0, 1.0),
        (2, "relation", {"amenity": "cafe"}, 1.0, 1.0),
        (3, "way", {"natural": "beach"}, 2.0000001, 2.0),
        (4, "node", {"natural": "beach"}, 2.0, 2.0000002),
        (5, "relation", {"natural": "beach"}, 3.0, 3.0),
        (6, "node", {"shop": "books"}, 1.0, 1.0),
        (7, "node", {"natural": "beach"}, None, None),
    ]
    df = spark.createDataFrame(rows, ddl)
    got = readers.tagged_pois(df, {"amenity": ["cafe", "bar"]}).collect()
    assert [(r["id"], r["name"], r["brand"]) for r in got] == [(1, "A", None)]
    assert {r["id"] for r in readers.tagged_pois(df).collect()} == {1, 6}
    assert {r["id"] for r in readers.beaches(df).collect()} == {4, 5}


def test_overrides(spark):
    ddl = "key string, value string, class string, category string, subcat string"
    df = spark.createDataFrame([("shop", "books", "a", "b", "c"), ("shop", "toys", "a", "t", "t")], ddl)
    got = {tuple(r) for r in readers.with_overrides(df, {"shop:books": ["x", "y", "z"], "bad": ["x", "y", "z"], "shop:few": ["x"]}).collect()}
    assert got == {("shop", "books", "x", "y", "z"), ("shop", "toys", "a", "t", "t")}


def test_load_checked_and_first(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    spark.range(2).selectExpr("id as other").write.parquet(f"{tmp_path}/b")
    paths = [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/none"]
    with pytest.warns(UserWarning):
        assert [df.count() for df in readers.load_checked(spark, paths, ["id"], warn_only=True)] == [3]
    with pytest.raises(ValueError, match="lacks id"):
        readers.load_checked(spark, paths[:2], ["id"])
    assert readers.read_first(spark, f"{tmp_path}/none", f"{tmp_path}/b").columns == ["other"]
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, f"{tmp_path}/none")


def test_month_rasters(spark):
    months = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    rows = [(f"/r/tmean/prism_tmean_2020{k:02d}_x.tif", 1) for k in range(1, 13)] + [("/r/tmean/t_jan_1.tif", 12), ("/r/tmean/t_JAN.tif", 1), ("/r/tmean/t.txt", 1)]
    rows += [("/r/ppt/z.tif", 24), ("/r/ppt/a.tif", 12)]
    got = {(r["var"], r["month"]): (r["path"], r["band"]) for r in readers.month_rasters(spark.createDataFrame(rows, "path string, bands int")).collect()}
    assert len(got) == 24 and got["tmean", 1] == ("/r/tmean/t_jan_1.tif", 1) and got["tmean", 2] == ("/r/tmean/prism_tmean_202002_x.tif", None)
    assert got["ppt", 5] == ("/r/ppt/a.tif", 5) and len(months) == 12
    with pytest.raises(ValueError, match="bands"):
        readers.month_rasters(spark.createDataFrame([("/r/tmin/a.tif", 3)], "path string, bands int"))


def test_election_airports_limits_and_cells(spark, tmp_path):
    (tmp_path / "e.csv").write_text("state,year,county_fips,county_name,office,party,candidatevotes,totalvotes\nMA,2024,1001.0,X,US PRESIDENT,DEMOCRAT,12,30\nMA,?,1,X,O,P,x,1\n")
    got = readers.read_election(spark, f"{tmp_path}/e.csv").collect()
    assert (got[0]["year"], got[0]["candidatevotes"], got[1]["year"], got[1]["candidatevotes"]) == (2024, 12, None, None)
    (tmp_path / "a.csv").write_text("IATA,AIRPORT,CITY,STATE,COUNTRY,LATITUDE,LONGITUDE\nBOS,Logan,B,MA,US,42.36,-71.0\nXXX,None,B,MA,US,?,1\n")
    assert [tuple(r) for r in readers.read_airports(spark, f"{tmp_path}/a.csv").collect()] == [("BOS", "Logan", -71.0, 42.36)]
    limits = {"category": {"cafe": {"max_minutes": 7, "top_k": 2}}, "_defaults": {"category": {"max_minutes": 60, "top_k": 12}}}
    df = spark.createDataFrame([("cafe",), ("park",)], "entity string")
    assert {tuple(r) for r in readers.limits_for(spark, limits, "category", df).collect()} == {("cafe", 7, 2), ("park", 60, 12)}
    spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "cell long, res int").write.parquet(f"{tmp_path}/c")
    assert [r["cell"] for r in readers.load_cells(spark, f"{tmp_path}/c", res=7).collect()] == [1]


def test_shards_prune_and_qa(spark, tmp_path):
    legs = spark.createDataFrame([(1, "cafe", 0, 10)], "anchor long, entity string, mode int, seconds int").withColumn("snapshot_ts", F.current_date())
    base = f"{tmp_path}/legs"
    for entity in ("cafe", "park", "two words"):
        sinks.write_shard(legs, base, 0, entity)
    assert spark.read.parquet(f"{base}/mode=0/entity=park").columns == ["anchor", "seconds", "snapshot_ts"]
    sinks.write_shard(legs.withColumn("entity", F.lit("old one")), base, 0, "old one")
    targets = spark.createDataFrame([(0, "cafe")], "mode int, entity string")
    assert sinks.prune(spark, base, targets) == [(0, "old one")]
    assert readers.read_legs(spark, base).count() == 1
    sinks.write_with_qa(legs, f"{tmp_path}/full", f"{tmp_path}/qa", ["anchor", "seconds"])
    assert spark.read.csv(f"{tmp_path}/qa", header=True).columns == ["anchor", "seconds"]
    sinks.write_pois(spark.createDataFrame([("p", 1.0)], "poi_id string, lon double"), f"{tmp_path}/pois")
    kept = spark.read.parquet(f"{tmp_path}/pois")
    assert kept.columns[:3] == ["poi_id", "name", "brand_id"] and dict(kept.dtypes)["provenance"] == "array<string>" and not checks.poi_errors(kept, ["poi_id"])


ODD = ["a&b", "café", "x=y", "50%", "a/b", "007", "two  words", "q?*:#", "日本"]


def test_odd_entity_names_are_written_pruned_and_read(spark, tmp_path):
    legs = spark.createDataFrame([(k, e, 0, 10 + k) for k, e in enumerate(ODD)], "anchor long, entity string, mode int, seconds int")
    base = f"{tmp_path}/legs"
    sinks.write_legs(legs, base)
    kept = lambda: {(r["entity"], r["anchor"]) for r in spark.read.schema("anchor long, seconds int, mode int, entity string").parquet(base).collect()}
    assert kept() == {(e, k) for k, e in enumerate(ODD)}
    for e in ODD[:5]:
        sinks.write_shard(legs.withColumn("anchor", F.col("anchor") + 100), base, 0, e)
    assert kept() == {(e, k + 100 * (k < 5)) for k, e in enumerate(ODD)}
    targets = spark.createDataFrame([(0, e) for e in ODD[1::2]], "mode int, entity string")
    assert set(sinks.prune(spark, base, targets)) == {(0, e) for e in ODD[::2]}
    assert {e for e, _ in kept()} == set(ODD[1::2]) and sinks.prune(spark, base, targets) == []


def test_ten_thousand_far_points(spark):
    """Points that have fewer places than asked for anywhere meet a cell of the coarsest level each, not millions."""
    points = spark.range(10_000).select("id", (F.col("id") % 360 - 180).cast("double").alias("lon"), (F.col("id") % 181 - 90).cast("double").alias("lat"))
    places = spark.createDataFrame([(1, 180.0, 90.0), (2, 0.0, 0.0)], "place long, p_lon double, p_lat double")
    got = spatial.knn_any(points, places, 3, metres=1e6, res=4)
    assert got.count() == 20_000
    cells = points.limit(1).select(F.size(geo.cells_around(F.col("lon"), F.col("lat"), 1e8, 0)).alias("n"))
    assert cells.first()["n"] == 128


@pytest.mark.parametrize("k", [None, 2])
def test_parted_search_of_named_sources_with_limits(spark, k):
    r = random.Random(9)
    rows = [(r.randrange(50), r.randrange(50), r.randrange(1, 9)) for _ in range(200)]
    starts = [(r.randrange(50), r.choice("abcd")) for _ in range(12)]
    # The k best are exact where all sources have one limit.
    limit = {"a": 30, "b": 12, "c": 4, "d": 0} if k is None else dict.fromkeys("abcd", 14)
    near = {}
    for name in limit:
        d = {n: 0 for n, s in starts if s == name}
        for _ in range(60):
            for u, v, w in rows:
                if u in d and d[u] + w <= limit[name]:
                    d[v] = min(d.get(v, 10**9), d[u] + w)
        near |= {(n, name): t for n, t in d.items()}
    want = {(n, s, t) for (n, s), t in near.items()}
    if k:
        want = {x for n in range(50) for x in sorted((y for y in want if y[0] == n), key=lambda y: (y[2], y[1]))[:k]}
    sources = spark.createDataFrame([(n, s, limit[s]) for n, s in starts], "node long, src string, limit long")
    got = graph.kbest_by_part(spark.createDataFrame(rows, "u long, v long, w long"), sources, k, parts=4).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_overlay_contract(spark):
    df = spark.createDataFrame([(1, 7), (1, 7), (None, 8)], "cell long, res int")
    assert checks.overlay_errors(df, ["cell", "res"]) == ["null cell", "repeated (cell, res)"]
    assert checks.overlay_errors(df, ["cell", "res", "x"]) == ["missing columns: x"]
    loose = df.select(F.col("cell").cast("string").alias("cell"), F.col("res").cast("long").alias("res")).where("cell is not null").distinct()
    assert checks.overlay_errors(loose, ["cell"]) == ["cell is string, not bigint", "res is bigint, not int"]
    assert checks.overlay_errors(checks.enforce_overlay_types(loose), ["cell"]) == []
    assert checks.poi_errors(spark.createDataFrame([("a",)], "provenance string"), ["poi_id"]) == ["missing columns: poi_id", "provenance is string, not a list"]


def test_column_contracts():
    months = ["jan", "feb"]
    full = [p.format(m) for m in months for p in ("temp_mean_{}_f_q", "ppt_{}_mm_q", "ppt_{}_in_q")]
    derived = ["temp_mean_ann_f_q", "temp_mean_summer_f_q", "temp_mean_winter_f_q", "ppt_ann_mm_q", "ppt_ann_in_q", "climate_label"]
    assert checks.climate_gaps(full + derived, months) == [] and checks.climate_gaps(full[1:] + derived[:-1], months) == ["temp_mean_jan_f_q", "climate_label"]
    contract = {"layer_name": "t", "min_zoom": 5, "max_zoom": 12, "required_properties": ["cell", "a0_id", "a0_s"]}
    assert checks.tile_errors({"t": ["cell", "a0_id", "a0_s"]}, (5, 12), contract) == []
    assert checks.tile_errors({"x": []}, (4, 12), contract) == ["no layer t", "min_zoom is 4, not 5"]
    assert checks.tile_errors({"t": ["a0_id"]}, (5, 12), contract) == ["missing properties: a0_s, cell", "no a0_id, a0_s"]
    assert checks.unpaired_slots(["cell", "a0_id", "a0_s", "a1_id", "a12_s", "age_s"]) == ["1", "12"]


def test_labels_and_brands(spark):
    df = spark.createDataFrame([("us_post office",), (" osm-data2x",), (None,)], "s string")
    assert [r[0] for r in df.select(text.pretty_label(F.col("s"))).collect()] == ["US Post Office", "OSM-Data2X", None]
    registry = spark.createDataFrame([("dunkin", "Dunkin'", "Dunkin Donuts|DD")], "brand_id string, canonical string, aliases string")
    assert [poi.resolve_brand_text(registry, x) for x in ("DD", " Dunkin' ", "Other", "")] == ["dunkin", "dunkin", "other", ""]


def test_pages_and_preferences(spark):
    df = spark.range(3)
    assert [tuple(r) for r in tables.page(df, [F.col("id")], 3).collect()] == [(0, False), (1, False), (2, False)]
    assert [tuple(r) for r in tables.page(df, [F.col("id").desc()], 2).collect()] == [(2, True), (1, True)]
    assert tables.page(df.where("false"), [F.col("id")], 2).count() == 0
    assert tables.prefer(df.where("id > 5"), df.where("id = 1")).count() == 1 and tables.prefer(df.where("id > 5")).count() == 0


def test_water_of_no_time(spark):
    df = spark.createDataFrame([(-71.0, 42.0)], "lon double, lat double")
    assert df.where(geo.approx_reach(F.col("lon"), F.col("lat"), -71.0, 42.0, 0)).count() == 0
    assert df.where(geo.approx_reach(F.col("lon"), F.col("lat"), -71.0, 42.0, 1)).count() == 1


def test_targets_stop_the_search_early(spark):
    r = random.Random(9)
    rows = [(k, k + 1, 1) for k in range(60)] + [(r.randrange(60), r.randrange(60), r.randrange(1, 9)) for _ in range(40)]
    edges = spark.createDataFrame(rows, "u long, v long, w long")
    sources = spark.createDataFrame([(0,), (5,)], "node long")
    goals = spark.createDataFrame([(7,), (9,), (9,)], "node long")
    got = {tuple(x) for x in graph.kbest_by_part(edges, sources, 2, 500, parts=6, targets=goals).select("node", "src", "d").collect()}
    assert got == {x for x in brute_kbest(rows, [0, 5], 2, 500) if x[0] in (7, 9)} and len(got) == 4


def test_ordered_fingerprint(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "k long, v long")
    one, same = (tables.ordered_fingerprint(x, ["v"], ["k"]).first() for x in (df, df.repartition(7).orderBy(F.desc("k"))))
    other = tables.ordered_fingerprint(df, ["v"], ["v", "k"]).first()
    assert one == same and one["n"] == 50 and one["digest"] != other["digest"]


def test_cache_is_built_again_when_sources_change(spark, tmp_path):
    from cellreach.sources import cache

    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    stamp = lambda *rows: spark.createDataFrame(list(rows), "path string, size long, stamp long")
    first = stamp(("a", 1, 1), ("b", 2, None))
    folder = f"{tmp_path}/cache"
    assert cache.load_or_build(spark, folder, first, build).count() == 1
    assert cache.load_or_build(spark, folder, first, build).count() == 1
    assert cache.load_or_build(spark, folder, stamp(("a", 1, 2), ("b", 2, None)), build).count() == 2
    assert [r["path"] for r in cache.changed_sources(first, stamp(("a", 1, 1), ("c", 2, None))).orderBy("path").collect()] == ["b", "c"]
