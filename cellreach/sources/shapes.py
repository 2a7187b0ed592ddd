"""Shapefile polygons as rows: a data source that reads a range of records a task.

    spark.dataSource.register(Shapefile)
    spark.read.format("shapefile").option("only", '{"STATEFP": ["25"]}').load("/boundaries/counties.shp")

Rows have the attributes of the .dbf file (text, long or double by its header; blanks are null) and rings, array<array<struct<x, y>>>, which count by the even-odd rule.
The .shx file says where records are, so a task reads one run of bytes of the .shp and of the .dbf file. Of records that `only` (values by attribute) leaves out, geometry
is not read where a task has no other. Records that the .dbf file marks as deleted are left out.

Read are polygons (plain, with Z or M) and null shapes, whose rings are null; coordinates are taken as degrees. A .prj file of a projected system is an error.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellreach.sources.files import ranges, read

RINGS = "array<array<struct<x: double, y: double>>>"
# Fixed values of the format: kinds of shapes, and the length of the headers.
NULL_SHAPE, POLYGONS, HEADER = 0, (5, 15, 25), 100
RECORDS_A_TASK = 512


@dataclass
class _Field:
    name: str
    kind: str
    at: int
    size: int

    def value(self, row: bytes, encoding: str):
        text = row[self.at : self.at + self.size].decode(encoding, "replace").strip(" \0")
        if not text or (self.kind != "string" and set(text) <= set("*?")):
            return None
        return text if self.kind == "string" else int(float(text)) if self.kind == "long" else float(text)


def fields_of(dbf: str) -> tuple[list[_Field], int, int, int]:
    """Fields of a .dbf file, its number of records, and the lengths of its header and of a record."""
    head = read(dbf, 0, 32)
    n, header, length = struct.unpack("<IHH", head[4:12])
    out, at = [], 1
    raw = read(dbf, 32, header - 32)
    for k in range(0, len(raw) - 31, 32):
        if raw[k] == 0x0D:
            break
        name, code, size, places = raw[k : k + 11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[k + 11]), raw[k + 16], raw[k + 17]
        kind = "string" if code not in "NF" else "long" if not places and code == "N" and size < 19 else "double"
        out.append(_Field(name, kind, at, size))
        at += size
    return out, n, header, length


def rings_of(content: bytes):
    """Rings of one record's content; None for a null shape."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind == NULL_SHAPE:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shape of kind {kind} is no polygon")
    parts, points = struct.unpack("<2i", content[36:44])
    starts = np.frombuffer(content, "<i4", parts, 44)
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return [[{"x": x, "y": y} for x, y in ring.tolist()] for ring in np.split(xy, starts[1:])]


@dataclass
class _Records(InputPartition):
    lo: int
    hi: int


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.shp = options["path"]
        stem = self.shp[:-4] if self.shp.lower().endswith(".shp") else self.shp
        self.shp, self.shx, self.dbf = f"{stem}.shp", f"{stem}.shx", f"{stem}.dbf"
        self.encoding = options.get("encoding", "utf-8")
        self.fields, self.n, self.header, self.length = fields_of(self.dbf)
        self.wanted = {name: set(values) for name, values in json.loads(options.get("only", "{}")).items()}
        try:
            projection = read(f"{stem}.prj").decode("utf-8", "replace")
        except FileNotFoundError:
            projection = ""
        if projection.lstrip().upper().startswith("PROJCS"):
            raise ValueError(f"{self.shp}: coordinates are not degrees")

    def partitions(self) -> list[InputPartition]:
        return [_Records(lo, hi) for lo, hi in ranges(self.n, -(-self.n // RECORDS_A_TASK))] or [_Records(0, 0)]

    def read(self, partition: _Records) -> Iterator[tuple]:
        lo, hi = partition.lo, partition.hi
        if hi <= lo:
            return
        index = np.frombuffer(read(self.shx, HEADER + 8 * lo, 8 * (hi - lo)), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows = read(self.dbf, self.header + lo * self.length, (hi - lo) * self.length)
        start, stop = int(index[:, 0].min()), int((index[:, 0] + index[:, 1] + 8).max())
        shapes = None
        for k, (at, size) in enumerate(index.tolist()):
            row = rows[k * self.length : (k + 1) * self.length]
            if row[:1] == b"*":
                continue
            values = {f.name: f.value(row, self.encoding) for f in self.fields}
            if any(values[name] not in some for name, some in self.wanted.items()):
                continue
            if shapes is None:
                shapes = read(self.shp, start, stop - start)
            yield (*values.values(), rings_of(shapes[at + 8 - start : at + 8 - start + size]))


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        fields = ShapefileReader(dict(self.options)).fields
        return ", ".join([f"`{f.name}` {f.kind}" for f in fields] + [f"rings {RINGS}"])

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(dict(self.options))


def read_counties(spark: SparkSession, path: str, states: list[str] = ()) -> DataFrame:
    """(geoid, name, statefp, rings) of a county shapefile, of some states or all."""
    spark.dataSource.register(Shapefile)
    reader = spark.read.format("shapefile")
    shapes = (reader.option("only", json.dumps({"STATEFP": list(states)})) if states else reader).load(path)
    if "GEOID" not in shapes.columns:
        raise ValueError(f"{path} has no GEOID")
    return shapes.selectExpr("GEOID as geoid", "NAME as name", "STATEFP as statefp", "rings")
