"""Map extracts made by hand: elements, tags and networks."""

import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cellreach.operators.graph import build_edges, kbest
from cellreach.sources import osm, readers


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


zigzag = lambda n: (n << 1) ^ (n >> 63)
field = lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)
packed = lambda k, values: field(k, b"".join(varint(v) for v in values))
deltas = lambda values: [zigzag(b - a) for a, b in zip([0, *values], values, strict=False)]


def block(nodes=(), dense=(), ways=(), relations=(), granularity=100, offsets=(0, 0)):
    table = [""]

    def index(text):
        if text not in table:
            table.append(text)
        return table.index(text)

    tags = lambda t: packed(2, [index(k) for k in t]) + packed(3, [index(v) for v in t.values()])
    place = lambda v, o: round((v * 1e9 - o) / granularity)
    groups = b""
    for i, lon, lat, t in nodes:
        groups += field(1, field(1, zigzag(i)) + tags(t) + field(8, zigzag(place(lat, offsets[0]))) + field(9, zigzag(place(lon, offsets[1]))))
    if dense:
        pairs = []
        for *_, t in dense:
            pairs += [x for k, v in t.items() for x in (index(k), index(v))] + [0]
        body = packed(1, deltas([d[0] for d in dense])) + packed(8, deltas([place(d[2], offsets[0]) for d in dense])) + packed(9, deltas([place(d[1], offsets[1]) for d in dense]))
        groups += field(2, body + (packed(10, pairs) if any(d[3] for d in dense) else b""))
    for i, refs, t in ways:
        groups += field(3, field(1, i) + tags(t) + packed(8, deltas(refs)))
    for i, members, t in relations:
        kinds = {"node": 0, "way": 1, "relation": 2}
        groups += field(4, field(1, i) + tags(t) + packed(8, [index(m[2]) for m in members]) + packed(9, deltas([m[1] for m in members])) + packed(10, [kinds[m[0]] for m in members]))
    body = field(2, groups) + b"".join(field(k, v) for k, v in ((17, granularity), (19, offsets[0]), (20, offsets[1])))
    return field(1, b"".join(field(1, s.encode()) for s in table)) + body


def blob(kind, data, deflate=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if deflate else field(1, data)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def extract(*blocks, needs=("OsmSchema-V0.6", "DenseNodes")):
    head = b"".join(field(4, n.encode()) for n in needs)
    return blob("OSMHeader", head) + b"".join(blob("OSMData", b, k % 2 == 0) for k, b in enumerate(blocks))


DENSE = [(10, -71.0, 42.0, {"amenity": "café é", "name": "x"}), (11, -71.01, 42.0, {}), (9_000_000_000, 179.5, -33.25, {"natural": "beach"}), (12, -71.02, 42.01, {})]
WAYS = [
    (100, [10, 11, 12], {"highway": "residential", "maxspeed": "30"}),
    (101, [12, 10], {"highway": "primary", "oneway": "yes"}),
    (102, [10, 12, 999], {"highway": "footway"}),
    (103, [10, 11], {"building": "yes"}),
]


@pytest.fixture
def pbf(tmp_path, monkeypatch):
    monkeypatch.setattr(osm, "TASK_BYTES", 1)
    path = tmp_path / "a.osm.pbf"
    relation = (7, [("way", 100, "outer"), ("node", 10, ""), ("relation", 7, "sub")], {"type": "multipolygon"})
    path.write_bytes(extract(block(dense=DENSE), block(nodes=[(-5, 1.5, 2.5, {"k": "v"})], granularity=1000, offsets=(500_000_000, -1_000_000_000 % (1 << 64))), block(ways=WAYS, relations=[relation])))
    return str(path)


def test_elements(spark, pbf):
    rows = osm.read_osm(spark, pbf).collect()
    nodes = {r["id"]: r for r in rows if r["kind"] == "node"}
    for i, lon, lat, tags in [*DENSE, (-5, 1.5, 2.5, {"k": "v"})]:
        assert math.isclose(nodes[i]["lon"], lon, abs_tol=1e-6) and math.isclose(nodes[i]["lat"], lat, abs_tol=1e-6) and nodes[i]["tags"] == tags
    assert len(nodes) == 5
    assert {r["id"]: (list(r["refs"]), r["tags"]) for r in rows if r["kind"] == "way"} == {i: (refs, t) for i, refs, t in WAYS}
    (relation,) = (r for r in rows if r["kind"] == "relation")
    assert [tuple(m) for m in relation["members"]] == [("way", 100, "outer"), ("node", 10, ""), ("relation", 7, "sub")] and relation["lon"] is None
    assert len(osm.OsmReader({"path": pbf}).partitions()) == 3


def test_filters_and_pois(spark, pbf):
    assert {r[0] for r in osm.read_osm(spark, pbf, "way", "relation").select("kind").distinct().collect()} == {"way", "relation"}
    df = osm.read_osm(spark, pbf)
    both = df.where("kind = 'way'").select("kind").unionAll(df.where("kind = 'node'").select("kind")).groupBy("kind").count()
    assert {tuple(r) for r in both.collect()} == {("way", 4), ("node", 5)}
    pois = readers.beaches(df.where("kind = 'node'").select("id", "kind", "tags", "lon", "lat"))
    assert [r["id"] for r in pois.collect()] == [9_000_000_000]


def test_network(spark, pbf):
    edges = {(r["u"], r["v"]): r for r in readers.read_edges(spark, pbf).collect()}
    assert set(edges) == {(10, 11), (11, 12), (12, 10)} and [edges[k]["oneway"] for k in ((10, 11), (12, 10))] == [False, True]
    assert 95 < edges[10, 11]["w"] < 105  # 826 m at 30 km/h
    walk = {(r["u"], r["v"]) for r in readers.read_edges(spark, pbf, "walk").select("u", "v").collect()}
    assert walk == {(10, 11), (11, 12), (12, 10), (10, 12)}
    graph = build_edges(readers.read_edges(spark, pbf))
    got = {r["node"]: r["d"] for r in kbest(graph, spark.createDataFrame([(10,)], "node long"), 1, 10_000).collect()}
    assert set(got) == {10, 11, 12} and got[11] == edges[10, 11]["w"] and got[12] == edges[10, 11]["w"] + edges[11, 12]["w"]


def test_odd_files(tmp_path, spark):
    for k, data in enumerate([b"not a map extract at all", extract(block(), needs=("LocationsOnWays",)), extract(block(dense=DENSE))[:-4]]):
        path = tmp_path / f"{k}.pbf"
        path.write_bytes(data)
        with pytest.raises(Exception):  # noqa: B017
            reader = osm.OsmReader({"path": str(path)})
            [b for p in reader.partitions() for b in reader.read(p)]
    (tmp_path / "none.pbf").write_bytes(extract())
    assert osm.read_osm(spark, f"{tmp_path}/none.pbf").count() == 0
    (tmp_path / "empty.pbf").write_bytes(extract(block()))
    assert osm.read_osm(spark, f"{tmp_path}/empty.pbf").select(F.count("id")).first()[0] == 0
