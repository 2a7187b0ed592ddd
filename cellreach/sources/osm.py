"""Map extracts in protocol-buffer form as rows: a data source that reads a run of blobs a task.

    spark.dataSource.register(OsmPbf)
    spark.read.format("osm_pbf").option("kinds", "way").load("/osm/state.osm.pbf")

Rows are (kind, id, tags, lon, lat, refs, members): nodes have lon and lat, ways refs (ids of nodes), relations members (kind, id, role). Of kinds that are not asked
for nothing is decoded, though their blocks are unpacked. Numbers are decoded whole columns at a time in numpy. (Filters are not pushed to the scan: two
scans of one DataFrame in one plan would share what was pushed last.)

Read are plain and deflated blobs; others, and a header that asks for features other than those of plain and dense nodes, raise a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellreach.functions import geo
from cellreach.sources.files import listed, read

KINDS = ("node", "way", "relation")
SCHEMA = (
    "kind string, id long, tags map<string,string>, lon double, lat double, refs array<long>,"
    " members array<struct<kind: string, id: long, role: string>>"
)
#: Bytes of blobs that a task reads.
TASK_BYTES = 4 << 20
FEATURES = {"OsmSchema-V0.6", "DenseNodes", "HistoricalInformation"}
#: Values of highway on which one cannot drive, or walk; and of service and access tags that close a way to cars.
NOT_DRIVEN = [
    "cycleway", "footway", "path", "pedestrian", "steps", "track", "corridor", "elevator", "escalator",
    "proposed", "construction", "bridleway", "abandoned", "platform", "raceway",
]
NOT_WALKED = ["cycleway", "motor", "proposed", "construction", "abandoned", "platform", "raceway", "motorway", "motorway_link"]
NOT_SERVED = ["parking", "parking_aisle", "private", "emergency_access"]


def numbers(data: bytes) -> np.ndarray:
    """All variable-length numbers of packed bytes, as uint64."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
    size = ends - starts + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[some] |= (raw[starts[some] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """Numbers whose lowest bit is the sign, as int64."""
    return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64)


def summed(data: bytes) -> np.ndarray:
    """Packed differences, added up."""
    return np.cumsum(signed(numbers(data)))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: whole numbers, and bytes of strings, messages and packed fields."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    while at < n:
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError("no field of a message")


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, where the blob begins, its size) of a file's blobs; their contents are passed over."""
    at = 0
    size = len_of(path)
    while at < size:
        head = read(path, at, 4)
        if len(head) < 4:
            raise ValueError(f"{path} ends within a blob")
        length = struct.unpack(">I", head)[0]
        if length > 1 << 16:
            raise ValueError(f"{path} is no map extract")
        header = dict(fields(read(path, at + 4, length)))
        yield header[1].decode(), at + 4 + length, header[3]
        at += 4 + length + header[3]


def len_of(path: str) -> int:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.get_file_info(name).size


def unpacked(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("a blob that is neither plain nor deflated")


def _cut(values: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Offsets and the values joined of lists."""
    at = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.array(at), np.concatenate(values) if values else np.empty(0, np.int64)


def _batch(kind: str, ids, keys: list, vals: list, strings: pa.Array, lon=None, lat=None, refs=None, members=None) -> pa.RecordBatch:
    n = len(ids)
    at, key = _cut(keys)
    _, val = _cut(vals)
    take = lambda index: strings.take(pa.array(index.astype(np.int64)))
    none = lambda t: pa.nulls(n, t)
    member = pa.struct([("kind", pa.string()), ("id", pa.int64()), ("role", pa.string())])
    columns = [
        pa.array([kind] * n, pa.string()), pa.array(np.asarray(ids, np.int64)), pa.MapArray.from_arrays(at, take(key), take(val)),
        none(pa.float64()) if lon is None else pa.array(lon), none(pa.float64()) if lat is None else pa.array(lat),
        none(pa.list_(pa.int64())) if refs is None else pa.ListArray.from_arrays(*(lambda o, v: (o, pa.array(v.astype(np.int64))))(*_cut(refs))),
        none(pa.list_(member)) if members is None else pa.array(members, pa.list_(member)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "id", "tags", "lon", "lat", "refs", "members"])


def block_rows(block: bytes, kinds: set[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a block of elements."""
    strings, groups, settings = pa.array([], pa.string()), [], {17: 100, 19: 0, 20: 0}
    for number, value in fields(block):
        if number == 1:
            strings = pa.array([v.decode("utf-8", "replace") for n, v in fields(value) if n == 1], pa.string())
        elif number == 2:
            groups.append(value)
        elif number in settings:
            settings[number] = value - (1 << 64) if value >> 63 else value
    place = lambda v, offset: (offset + settings[17] * v) * 1e-9
    whole = lambda v: v - (1 << 64) if v >> 63 else v
    for group in groups:
        found: dict[str, list] = {k: [] for k in KINDS}
        for number, value in fields(group):
            if number == 2 and "node" in kinds:
                yield _dense(value, strings, place, settings)
            elif number in (1, 3, 4) and (kind := {1: "node", 3: "way", 4: "relation"}[number]) in kinds:
                found[kind].append(dict(fields(value)))
        for kind, rows in found.items():
            if not rows:
                continue
            keys, vals = ([numbers(r.get(k, b"")) for r in rows] for k in (2, 3))
            if kind == "node":
                one = lambda k: signed(np.array([r.get(k, 0) for r in rows], np.uint64))  # noqa: B023, E731
                yield _batch(kind, one(1), keys, vals, strings, place(one(9), settings[20]), place(one(8), settings[19]))
                continue
            ids = [whole(r[1]) for r in rows]
            if kind == "way":
                yield _batch(kind, ids, keys, vals, strings, refs=[summed(r.get(8, b"")) for r in rows])
                continue
            text = strings.to_pylist()
            lists = [zip(numbers(r.get(10, b"")), summed(r.get(9, b"")), numbers(r.get(8, b"")), strict=True) for r in rows]
            yield _batch(kind, ids, keys, vals, strings, members=[[{"kind": KINDS[int(k)], "id": int(m), "role": text[int(role)]} for k, m, role in x] for x in lists])


def _dense(data: bytes, strings: pa.Array, place, settings: dict) -> pa.RecordBatch:
    parts = dict(fields(data))
    ids, lat, lon = (summed(parts.get(k, b"")) for k in (1, 8, 9))
    pairs = numbers(parts.get(10, b"")).astype(np.int64)
    keys = vals = [np.empty(0, np.int64)] * len(ids)
    if len(pairs):
        # Pairs of a node end with a 0 where a key would be: a 0 at an even place after the last end.
        ends, at = [], 0
        zero = np.flatnonzero(pairs == 0)
        for z in zero.tolist():
            if z >= at and (z - at) % 2 == 0:
                ends.append(z)
                at = z + 1
        starts = [0] + [e + 1 for e in ends[:-1]]
        keys, vals = ([pairs[s + k : e : 2] for s, e in zip(starts, ends, strict=True)] for k in (0, 1))
    return _batch("node", ids, list(keys), list(vals), strings, place(lon, settings[20]), place(lat, settings[19]))


@dataclass
class _Blobs(InputPartition):
    path: str
    blobs: list[tuple[int, int]]


class OsmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = listed(options["path"], ".pbf")
        self.kinds = set(options["kinds"].split(",")) if options.get("kinds") else set(KINDS)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files:
            some, size = [], 0
            for kind, at, n in blobs(path):
                if kind == "OSMHeader":
                    needed = {v.decode() for k, v in fields(unpacked(read(path, at, n))) if k == 4}
                    if needed - FEATURES:
                        raise ValueError(f"{path} needs {', '.join(sorted(needed - FEATURES))}")
                elif kind == "OSMData":
                    some.append((at, n))
                    size += n
                    if size >= TASK_BYTES:
                        out.append(_Blobs(path, some))
                        some, size = [], 0
            if some:
                out.append(_Blobs(path, some))
        return out or [_Blobs("", [])]

    def read(self, partition: _Blobs) -> Iterator[pa.RecordBatch]:
        for at, n in partition.blobs:
            yield from block_rows(unpacked(read(partition.path, at, n)), self.kinds)


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OsmReader:
        return OsmReader(dict(self.options))


def read_osm(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """SCHEMA of the elements of a path, of some kinds or all."""
    spark.dataSource.register(OsmPbf)
    reader = spark.read.format("osm_pbf")
    return (reader.option("kinds", ",".join(kinds)) if kinds else reader).load(path)


def network(ways: DataFrame, nodes: DataFrame, mode: str = "drive") -> DataFrame:
    """Ways of a network (u, v, length, highway, maxspeed, oneway) of ways (tags, refs) and nodes (id, lon, lat).

    There is a row for each stretch between two nodes of a way that one can drive or walk, in metres. Stretches with a node that the extract lacks are left out.
    """
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    no = lambda k, values: F.coalesce(tag(k).isin(list(values)), F.lit(False))
    closed = no("highway", NOT_WALKED) | no("foot", ["no"]) | no("area", ["yes"]) | no("service", ["private"])
    if mode != "walk":
        closed = no("highway", NOT_DRIVEN) | no("motor_vehicle", ["no"]) | no("motorcar", ["no"]) | no("service", NOT_SERVED) | no("area", ["yes"])
    open_ways = ways.where(tag("highway").isNotNull() & ~closed & (F.size("refs") > 1))
    step = F.transform(F.sequence(F.lit(1), F.size("refs") - 1), lambda k: F.struct(F.get("refs", k - 1).alias("u"), F.get("refs", k).alias("v")))
    steps = open_ways.select(F.explode(step).alias("x"), *[tag(k).alias(k) for k in ("highway", "maxspeed", "oneway")]).select("x.u", "x.v", "highway", "maxspeed", "oneway")
    ends = [nodes.select(F.col("id").alias(n), F.col("lon").alias(f"{n}_lon"), F.col("lat").alias(f"{n}_lat")) for n in ("u", "v")]
    placed = steps.join(ends[0], "u").join(ends[1], "v")
    length = geo.metres_between(*[F.col(c) for c in ("u_lon", "u_lat", "v_lon", "v_lat")])
    return placed.select("u", "v", length.alias("length"), "highway", "maxspeed", "oneway")
