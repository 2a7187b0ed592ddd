"""GeoTIFF pixels as rows: a data source that reads a file by strips or tiles, each in a task of its own.

    spark.dataSource.register(GeoTiff)
    spark.read.format("geotiff").load("/rasters/ppt")             # all bands
    spark.read.format("geotiff").option("bands", "1,2").load(...)  # these alone are decoded

Rows are (path, band, row, col, lon, lat, value); lon and lat are the middle of the pixel. Value is null where the file says so (its no-data value, -9999 if it names
none) and for NaN. Of bands that are not asked for, no plane is read.

Read are classic and big files of either byte order, whole or floating samples of 8 to 64 bits, chunky or by plane, plain or by deflate or LZW, with horizontal
or floating-point differences; north-up in degrees. Others raise a ValueError that says what is amiss.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellreach.sources.files import listed, read

NO_DATA = -9999.0
SCHEMA = "path string, band int, row int, col int, lon double, lat double, value double"
# Fixed values of the format: tags, and the size and code of the types that their values have.
WIDTH, LENGTH, BITS, COMPRESSION, STRIP_AT, PER_PIXEL, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_BYTES, SAMPLE = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, GDAL_NO_DATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
KINDS = {1: "u", 2: "i", 3: "f"}
#: Bytes of a file that are read to find its directory, and chunks of pixels that a task reads.
HEAD, CHUNKS_A_TASK = 1 << 16, 16


@dataclass
class Layout:
    """Where the pixels of a file are and what they mean."""

    path: str
    width: int
    height: int
    bands: int
    kind: str  # numpy type of a sample
    compression: int
    predictor: int
    planar: bool
    tile: tuple[int, int]  # width and height of a chunk
    at: list[int]
    size: list[int]
    origin: tuple[float, float]
    step: tuple[float, float]
    no_data: float
    tags: dict = field(default_factory=dict, repr=False)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[0])

    @property
    def per_plane(self) -> int:
        return self.across * -(-self.height // self.tile[1])


def layout(path: str) -> Layout:
    """The layout that a file's first directory describes."""
    head = read(path, 0, HEAD)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError(f"{path} is no TIFF")
    big = version == 43

    def bytes_at(at: int, n: int) -> bytes:
        return head[at : at + n] if at + n <= len(head) else read(path, at, n)

    at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
    count_size, entry, room = (8, 20, 8) if big else (2, 12, 4)
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", bytes_at(at, count_size))[0]
    raw = bytes_at(at + count_size, n * entry)
    tags = {}
    for k in range(n):
        row = raw[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(f"{order}HH", row[:4])
        count = struct.unpack(f"{order}{'Q' if big else 'I'}", row[4 : 4 + room])[0]
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        value = row[4 + room : 4 + 2 * room]
        if size * count > room:
            value = bytes_at(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0], size * count)
        tags[tag] = value[:count] if code == "s" else list(struct.unpack(f"{order}{code * count}", value[: size * count]))
    return _described(path, order, tags)


def _described(path: str, order: str, tags: dict) -> Layout:
    one = lambda tag, other=None: tags.get(tag, [other])[0]
    bands, bits, sample = one(PER_PIXEL, 1), tags.get(BITS, [1]), tags.get(SAMPLE, [1])
    keys = tags.get(GEO_KEYS, [])
    model = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}.get(1024, 2)
    fit = {
        "samples of several kinds": len(set(bits)) > 1 or len(set(sample)) > 1,
        f"{bits[0]}-bit samples": bits[0] not in (8, 16, 32, 64),
        f"sample format {sample[0]}": sample[0] not in KINDS or (sample[0] == 3 and bits[0] < 32),
        f"compression {one(COMPRESSION, 1)}": one(COMPRESSION, 1) not in (1, 5, 8, 32946),
        f"predictor {one(PREDICTOR, 1)}": one(PREDICTOR, 1) not in (1, 2, 3),
        "coordinates that are not degrees": model != 2,
    }
    for what, bad in fit.items():
        if bad:
            raise ValueError(f"{path}: cannot read {what}")
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (dx, dy), tie = tags[PIXEL_SCALE][:2], tags[TIE_POINT]
        origin, step = (tie[3] - tie[0] * dx, tie[4] + tie[1] * dy), (dx, -dy)
    elif TRANSFORM in tags and tags[TRANSFORM][1] == tags[TRANSFORM][4] == 0:
        m = tags[TRANSFORM]
        origin, step = (m[3], m[7]), (m[0], m[5])
    else:
        raise ValueError(f"{path}: no place on the map, or turned against it")
    width, height = one(WIDTH), one(LENGTH)
    tiled = TILE_AT in tags
    shape = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    text = bytes(tags.get(GDAL_NO_DATA, b"")).rstrip(b"\0 ").strip()
    return Layout(
        path, width, height, bands, f"{order}{KINDS[sample[0]]}{bits[0] // 8}", one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2, shape,
        tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], origin, step, float(text) if text else NO_DATA,
    )


def _unpacked(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the first bits highest; 256 starts anew and 257 ends."""
    out, table, width, held, bits, before = [], [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before:
            table.append(before + now[:1])
        before = now
        width = 9 + (len(table) + 1 > 511) + (len(table) + 1 > 1023) + (len(table) + 1 > 2047)
    return b"".join(out)


def pixels(of: Layout, chunk: int) -> np.ndarray:
    """The samples of a chunk as (rows, columns, bands of it)."""
    width, height = of.tile
    samples = 1 if of.planar else of.bands
    data = read(of.path, of.at[chunk], of.size[chunk])
    if of.compression == 5:
        data = _unpacked(data)
    elif of.compression != 1:
        data = zlib.decompress(data)
    kind = np.dtype(of.kind)
    height = min(height, len(data) // (width * samples * kind.itemsize))
    data = data[: height * width * samples * kind.itemsize]
    if of.predictor == 3:  # bytes by significance, highest first, then differences of bytes
        rows = np.cumsum(np.frombuffer(data, np.uint8).reshape(height, width * kind.itemsize, samples), 1, np.uint8).reshape(height, kind.itemsize, width * samples)
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(height, width, samples)
    out = np.frombuffer(data, kind).reshape(height, width, samples)
    if of.predictor == 2:
        out = np.cumsum(out.astype(kind.newbyteorder("=")), 1, dtype=kind.newbyteorder("="))
    return out


@dataclass
class _Chunks(InputPartition):
    of: Layout
    chunks: list[int]


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = listed(options["path"], (".tif", ".tiff"))
        self.bands = {int(b) for b in options["bands"].split(",")} if options.get("bands") else None

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files:
            of = layout(path)
            planes = [b for b in range(1, of.bands + 1) if self.bands is None or b in self.bands]
            first = [(b - 1) * of.per_plane for b in planes] if of.planar else [0] * bool(planes)
            chunks = [at + k for at in first for k in range(of.per_plane)]
            out += [_Chunks(of, chunks[k : k + CHUNKS_A_TASK]) for k in range(0, len(chunks), CHUNKS_A_TASK)]
        return out or [_Chunks(None, [])]

    def read(self, partition: _Chunks) -> Iterator[pa.RecordBatch]:
        of = partition.of
        for chunk in partition.chunks:
            block = pixels(of, chunk)
            place = chunk % of.per_plane
            row = place // of.across * of.tile[1] + np.arange(block.shape[0])
            col = place % of.across * of.tile[0] + np.arange(block.shape[1])
            row, col = row[row < of.height], col[col < of.width]
            for k in range(block.shape[2]):
                band = chunk // of.per_plane + 1 if of.planar else k + 1
                if self.bands is not None and band not in self.bands:
                    continue
                value = block[: len(row), : len(col), k].astype(np.float64).ravel()
                rows, cols = (x.ravel() for x in np.meshgrid(row, col, indexing="ij"))
                none = np.isnan(value) | (value == of.no_data) | (value == np.float32(of.no_data))
                columns = [
                    pa.array([of.path] * len(value)), pa.array(np.full(len(value), band, np.int32)), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)),
                    pa.array(of.origin[0] + (cols + 0.5) * of.step[0]), pa.array(of.origin[1] + (rows + 0.5) * of.step[1]), pa.array(value, mask=none),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "band", "row", "col", "lon", "lat", "value"])


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options))


def raster_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bands, origin_x, origin_y, step_x, step_y, width, height) of the rasters of a path, for month_rasters and RasterGrid."""
    rows = [(f, (x := layout(f)).bands, *x.origin, *x.step, x.width, x.height) for f in listed(path, (".tif", ".tiff"))]
    return spark.createDataFrame(rows, "path string, bands int, origin_x double, origin_y double, step_x double, step_y double, width int, height int")


def read_rasters(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """SCHEMA of the rasters of a path, of some bands or all."""
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("geotiff")
    return (reader.option("bands", ",".join(map(str, bands))) if bands else reader).load(path)
