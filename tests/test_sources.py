"""Data sources over files made by hand: rasters, shapefiles and REST pages; all-touched means and cells by largest share."""

import http.server
import json
import struct
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellreach.operators import polygons
from cellreach.operators.polygons import RasterGrid
from cellreach.sources import rasters, rest, shapes


def lzw(data):
    """Codes of 9 to 12 bits, cleared when the table is full."""
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            out.append((bits >> (n - 8)) & 255)
            n -= 8

    table, width = {bytes([k]): k for k in range(256)}, 9
    put(256, 9)
    now, free = b"", 258
    for byte in data:
        if now + bytes([byte]) in table:
            now += bytes([byte])
            continue
        put(table[now], width)
        table[now + bytes([byte])] = free
        free += 1
        width = 9 + (free > 511) + (free > 1023) + (free > 2047)
        if free == 4094:
            put(256, width)
            table, width, free = {bytes([k]): k for k in range(256)}, 9, 258
        now = bytes([byte])
    put(table[now], width)
    put(257, 9 + (free + 1 > 511) + (free + 1 > 1023) + (free + 1 > 2047))
    if n:
        out.append((bits << (8 - n)) & 255)
    return bytes(out)


def tiff(values, order="<", big=False, tile=None, rows=3, planar=False, compression=1, predictor=1, no_data=None, origin=(-75.0, 45.0), step=0.5, extra=()):
    """Bytes of a GeoTIFF of values (rows, columns, bands)."""
    values = values.astype(values.dtype.newbyteorder(order))
    h, w, bands = values.shape
    tw, th = tile or (w, rows)
    chunks = []
    for plane in range(bands if planar else 1):
        block = values[:, :, plane : plane + 1] if planar else values
        for r in range(0, h, th):
            for c in range(0, w, tw):
                part = block[r : r + th, c : c + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(values.dtype)
                raw = np.ascontiguousarray(part).tobytes()
                if predictor == 3:
                    size = values.dtype.itemsize
                    by = np.frombuffer(np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).tobytes(), np.uint8).reshape(part.shape[0], -1, size).transpose(0, 2, 1)
                    by = by.reshape(part.shape[0], -1, part.shape[2])
                    raw = np.concatenate([by[:, :1], np.diff(by, axis=1)], 1).astype(np.uint8).tobytes()
                chunks.append(zlib.compress(raw) if compression == 8 else lzw(raw) if compression == 5 else raw)
    sample = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [values.dtype.itemsize * 8] * bands), (259, 3, [compression]), (277, 3, [bands]), (284, 3, [2 if planar else 1]), (317, 3, [predictor]), (339, 3, [sample] * bands)]
    tags += [(33550, 12, [step, step, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0])] + list(extra)
    if no_data is not None:
        tags.append((42113, 2, str(no_data).encode() + b"\0"))
    tags += [(322, 4, [tw]), (323, 4, [th]), (324, 4, None), (325, 4, [len(c) for c in chunks])] if tile else [(278, 4, [th]), (273, 4, None), (279, 4, [len(c) for c in chunks])]
    tags.sort(key=lambda t: t[0])
    head = 16 if big else 8
    at, places = head, []
    for c in chunks:
        places.append(at)
        at += len(c)
    entries, loose = [], b""
    start = at + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    for tag, kind, value in tags:
        value = places if value is None else value
        code = {2: "s", 3: "H", 4: "I", 12: "d"}[kind]
        raw = value if kind == 2 else struct.pack(f"{order}{len(value)}{code}", *value)
        room = 8 if big else 4
        if len(raw) > room:
            field = struct.pack(order + ("Q" if big else "I"), start + len(loose))
            loose += raw
        else:
            field = raw.ljust(room, b"\0")
        entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(value)) + field)
    mark = {"<": b"II", ">": b"MM"}[order]
    first = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    directory = struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(entries) + struct.pack(order + ("Q" if big else "I"), 0)
    return first + b"".join(chunks) + directory + loose


def raster(h, w, bands, kind):
    r = np.random.default_rng(h * w)
    out = (r.normal(size=(h, w, bands)) * 40).astype(kind)
    out[0, 0, 0] = out[h - 1, w - 1, bands - 1] = -99
    return out


CASES = [
    dict(kind="f4", no_data=-99),
    dict(kind="i2", no_data=-99, order=">", rows=2),
    dict(kind="f8", big=True, tile=(16, 16), no_data=-99, compression=8),
    dict(kind="f4", tile=(16, 32), planar=True, compression=8, predictor=3, no_data="-99.0"),
    dict(kind="i4", compression=8, predictor=2, no_data=-99),
    dict(kind="i2", compression=5, predictor=2, planar=True, no_data=-99),
    dict(kind="i1", compression=5, no_data=-99, rows=50),
    dict(kind="f4", order=">", big=True, compression=5, predictor=3, no_data=-99),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_raster_kinds(spark, tmp_path, case):
    args = dict(CASES[case])
    want = raster(37, 50, 2, args.pop("kind"))
    (tmp_path / "a.tif").write_bytes(tiff(want, **args))
    got = rasters.read_rasters(spark, f"{tmp_path}/a.tif").toPandas()
    assert len(got) == want.size
    back = np.full(want.shape, np.nan)
    back[got["row"], got["col"], got["band"] - 1] = got["value"]
    assert np.array_equal(back, np.where(want == -99, np.nan, want.astype(float)), equal_nan=True)
    assert np.allclose(got["lon"], -75 + (got["col"] + 0.5) * 0.5) and np.allclose(got["lat"], 45 - (got["row"] + 0.5) * 0.5)


def test_raster_folder_bands_and_errors(spark, tmp_path):
    (tmp_path / "b.tif").write_bytes(tiff(raster(5, 6, 3, "f4"), planar=True))
    (tmp_path / "a.tif").write_bytes(tiff(np.full((4, 4, 1), -9999, "f4")))
    (tmp_path / "notes.txt").write_text("x")
    both = rasters.read_rasters(spark, str(tmp_path))
    assert both.count() == 16 + 90 and both.where("value is null").count() == 16  # -9999 where no other value is named
    assert {r[0] for r in rasters.read_rasters(spark, str(tmp_path), [2, 3]).select("band").distinct().collect()} == {2, 3}
    assert both.where("band = 3").count() == 30 and both.where("band in (1, 7)").count() == 46
    files = {r["path"].rsplit("/", 1)[1]: r["bands"] for r in rasters.raster_files(spark, str(tmp_path)).collect()}
    assert files == {"a.tif": 1, "b.tif": 3}
    for k, bad in enumerate([b"no tiff at all", tiff(raster(4, 4, 1, "f4"), extra=[(34735, 3, [1, 1, 0, 1, 1024, 0, 1, 1])])]):
        (tmp_path / f"bad{k}").write_bytes(bad)
        with pytest.raises(ValueError):
            rasters.layout(f"{tmp_path}/bad{k}")


def test_bands_reach_the_scan(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(raster(5, 6, 3, "f4"), planar=True))
    reader = rasters.GeoTiffReader({"path": f"{tmp_path}/a.tif", "bands": "2"})
    assert {c for p in reader.partitions() for c in p.chunks} == {2, 3}


def clipped(ring, box):
    """A ring cut to a box (Sutherland-Hodgman)."""
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        ring = out
    return ring


RINGS = "poly int, rings array<array<struct<x: double, y: double>>>"


def as_rows(shapes_):
    return [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] if rings is not None else None) for k, rings in shapes_]


@pytest.mark.parametrize("few", [0, 256, 10**6])
def test_touched_pixels(spark, monkeypatch, few):
    monkeypatch.setattr(polygons, "FEW_PIXELS", few)
    r = np.random.default_rng(7)
    made = []
    for k in range(40):
        x, y, size = r.uniform(-76, -66), r.uniform(38, 46), r.choice([0.02, 0.4, 3.0])
        a = np.sort(r.uniform(0, 2 * np.pi, 7))
        made.append((k, [[(x + size * np.cos(t), y + size * np.sin(t)) for t in a]]))  # convex
    df = spark.createDataFrame(as_rows([*made, (90, None), (91, [[(500.0, 500.0), (501.0, 500.0), (500.0, 501.0)]])]), RINGS)
    grid = RasterGrid(-75.0, 45.0, 0.5, 0.25, 15, 21)
    got = {tuple(x) for x in polygons.touched_pixels(df, grid).collect()}
    want = {(k, i, j) for k, (ring,) in made for i in range(21) for j in range(15) if clipped(ring, (-75 + j * 0.5, 45 - (i + 1) * 0.25, -75 + (j + 1) * 0.5, 45 - i * 0.25))}
    assert got == want


def test_zonal_mean_touched(spark, tmp_path):
    values = np.arange(20 * 12, dtype="f4").reshape(20, 12, 1)
    values[3, 3] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(values, origin=(10.0, 50.0), step=1.0))
    pixels = rasters.read_rasters(spark, f"{tmp_path}/a.tif")
    shapes_ = [(1, [[(13.2, 46.2), (13.4, 46.2), (13.3, 46.4)]]), (2, [[(12.9, 45.9), (13.1, 45.9), (13.1, 46.1), (12.9, 46.1)]]), (3, [[(0, 0), (1, 0), (0, 1)]])]
    got = {r["poly"]: (r["n"], r["mean"]) for r in polygons.zonal_mean_touched(spark.createDataFrame(as_rows(shapes_), RINGS), pixels, RasterGrid(10.0, 50.0, 1.0, 1.0, 12, 20)).collect()}
    of = lambda *at: float(np.mean([float(values[r, c, 0]) for r, c in at]))
    assert got == {1: (0, None), 2: (3, of((3, 2), (4, 2), (4, 3))), 3: (0, None)}


def test_cells_by_largest_share(spark):
    """Two rectangles side by side: a cell goes to the one with most of it, by area."""
    from cellreach.functions import h3

    left, right = [(-72.0, 41.0), (-71.0, 41.0), (-71.0, 42.0), (-72.0, 42.0)], [(-71.0, 41.0), (-70.0, 41.0), (-70.0, 42.0), (-71.0, 42.0)]
    df = spark.createDataFrame(as_rows([(1, [left]), (2, [right])]), RINGS)
    got = {r["cell"]: (r["poly"], r["share"]) for r in polygons.cells_by_largest_share(df, 5).collect()}

    def area(ring):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2

    for cell, ring in zip(got, h3.boundaries(np.array(list(got))), strict=True):
        ring = [tuple(p) for p in ring[:-1]]
        parts = [area(clipped(ring, box)) / area(ring) for box in ((-72, 41, -71, 42), (-71, 41, -70, 42))]
        poly, share = got[cell]
        assert abs(parts[poly - 1] - share) < 0.02 and parts[poly - 1] >= max(parts) - 0.02
    assert {p for p, _ in got.values()} == {1, 2} and any(s == 1.0 for _, s in got.values())


def write_shapes(folder, name, records, kind=5, deleted=()):
    """.shp, .shx and .dbf of records (attributes, rings)."""
    fields = [("GEOID", "C", 5, 0), ("NAME", "C", 12, 0), ("STATEFP", "C", 2, 0), ("ALAND", "N", 14, 0), ("RATE", "N", 9, 3)]
    shp, shx, rows = b"", b"", b""
    for n, (values, rings) in enumerate(records):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            flat = [p for ring in rings for p in ring]
            starts = np.cumsum([0] + [len(r) for r in rings])[:-1]
            xs, ys = zip(*flat, strict=True)
            content = struct.pack("<i4d2i", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * len(flat)}d", *[c for p in flat for c in p])
            content += b"\0" * (16 + 8 * len(flat)) * (kind == 15)
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(content) // 2)
        shp += struct.pack(">2i", n + 1, len(content) // 2) + content
        rows += b"*" if n in deleted else b" "
        for value, (_, code, size, places) in zip(values, fields, strict=True):
            text = "" if value is None else f"{value:.{places}f}" if code == "N" else value
            raw = text.encode()
            rows += raw.rjust(size) if code == "N" else raw.ljust(size)
    head = lambda body: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    (folder / f"{name}.shp").write_bytes(head(shp) + shp)
    (folder / f"{name}.shx").write_bytes(head(shx) + shx)
    described = b"".join(n.encode().ljust(11, b"\0") + c.encode() + b"\0" * 4 + bytes([size, places]) + b"\0" * 14 for n, c, size, places in fields)
    length = 1 + sum(f[2] for f in fields)
    (folder / f"{name}.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(records), 32 + len(described) + 1, length) + described + b"\r" + rows)


@pytest.mark.parametrize("kind", [5, 15])
def test_shapefile(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(shapes, "RECORDS_A_TASK", 2)
    square = lambda x, y, s=1.0: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
    records = [
        (("25001", "Barnstable", "25", 1000, 1.5), [square(0, 0, 4), square(1, 1)]),
        (("25003", "Ñame é", "25", None, None), [square(10, 0)]),
        (("33001", "Belknap", "33", 7, -2.25), None),
        (("33003", "Gone", "33", 7, 0.0), [square(5, 5)]),
        (("44001", "Bristol", "44", 0, 0.0), [square(20, 0), square(22, 0)]),
    ]
    write_shapes(tmp_path, "c", records, kind, deleted={3})
    spark.dataSource.register(shapes.Shapefile)
    df = spark.read.format("shapefile").load(f"{tmp_path}/c.shp")
    assert df.dtypes[:5] == [("GEOID", "string"), ("NAME", "string"), ("STATEFP", "string"), ("ALAND", "bigint"), ("RATE", "double")]
    got = {r["GEOID"]: (r["NAME"], r["ALAND"], r["RATE"], r["rings"] and [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]) for r in df.collect()}
    assert got == {v[0]: (v[1], v[3], v[4], rings) for v, rings in records if v[0] != "33003"}
    some = shapes.read_counties(spark, f"{tmp_path}/c.shp", ["25", "44"])
    assert {r["geoid"] for r in some.collect()} == {"25001", "25003", "44001"}
    cells = polygons.h3_polyfill(some, 5, id_col="geoid").groupBy("geoid").count().collect()
    assert {r["geoid"] for r in cells} == {"25001", "25003", "44001"}
    reader = shapes.ShapefileReader({"path": f"{tmp_path}/c.shp", "only": '{"STATEFP": ["44"]}'})
    assert [row[0] for p in reader.partitions() for row in reader.read(p)] == ["44001"]


def test_counties_cells_and_election(spark, tmp_path):
    """County shapes to cells to the overlay of the vote, as one query."""
    box = lambda x: [[(x, 41.0), (x, 41.5), (x + 0.5, 41.5), (x + 0.5, 41.0), (x, 41.0)]]
    write_shapes(tmp_path, "c", [(("25001", "A", "25", 1, 1.0), box(-71.0)), (("25003", "B", "25", 1, 1.0), box(-70.5)), (("33001", "C", "33", 1, 1.0), box(-70.0))])
    votes = spark.createDataFrame([("25001", 4), ("25003", 1)], "geoid string, lean int")
    cells = polygons.cells_by_largest_share(shapes.read_counties(spark, f"{tmp_path}/c.shp", ["25"]), 6, "geoid")
    found = cells.join(votes, "geoid").groupBy("lean").count().collect()
    assert {r["lean"] for r in found} == {1, 4} and all(r["count"] > 40 for r in found)


@pytest.fixture
def server():
    rows = [{"id": k, "name": f"n{k}"} for k in range(23)]
    seen = {"failures": 2, "asked": []}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen["asked"].append(asked)
            if seen["failures"]:
                seen["failures"] -= 1
                self.send_error(503)
                return
            if self.path == "/refused":
                self.send_error(403)
                return
            lo = (asked["Page"] - 1) * asked["PageSize"]
            answer = {"Results": rows[lo : lo + asked["PageSize"]]}
            if self.path == "/total":
                answer["TotalCount"] = len(rows)
            data = json.dumps(answer).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", rows, seen
    own.shutdown()


@pytest.mark.parametrize("path", ["/total", "/open"])
def test_rest_pages(spark, server, path):
    url, rows, seen = server
    spark.dataSource.register(rest.RestPages)
    df = spark.read.format("rest_pages").options(url=url + path, body='{"State": "MA"}', pageSize=5, pause=0.01).load()
    got = sorted((r["page"], r["seq"], json.loads(r["value"])["id"]) for r in df.collect())
    assert got == [(k // 5 + 1, k % 5, k) for k in range(23)]
    assert all(a["State"] == "MA" for a in seen["asked"]) and df.rdd.getNumPartitions() == (5 if path == "/total" else 1)


def test_rest_errors_and_other_sources(spark, server, tmp_path):
    url, rows, _ = server
    with pytest.raises(Exception):  # noqa: B017
        rest.RestReader({"url": f"{url}/refused", "pause": "0.01"}).page(1)
    ids = lambda df: sorted(json.loads(r["value"])["id"] for r in df.collect())
    assert ids(rest.all_results(spark, f"{url}/total")) == list(range(23)) and rest.all_results(spark, None).count() == 0
    (tmp_path / "a.json").write_text(json.dumps(rows[:3]))
    (tmp_path / "b.json").write_text(json.dumps({"Results": rows[3:5]}))
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows[5:7])) + "\n")
    assert ids(rest.all_results(spark, f"{tmp_path}/a.json")) == [0, 1, 2] and ids(rest.all_results(spark, str(tmp_path))) == list(range(7))
