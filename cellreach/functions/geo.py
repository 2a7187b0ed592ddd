"""Cells, distances and simple geometry as Column arithmetic.

The default grid is a hierarchical square grid: a cell is (x, y) at a resolution packed into one long, and its
parent is a bit shift. Its ids are not H3 ids; `h3_parent` does the id arithmetic for real H3 ids.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_000.0
#: Cells of the square grid have 360 / 2**(res + 4) degrees a side.
BASE_BITS, AXIS_BITS = 4, 28


def _axis_cell(value: Column, start: float, res: int) -> Column:
    """The cell number along an axis from start to -start degrees; what lies beyond an end is in the last cell there."""
    per_degree = (1 << (res + BASE_BITS)) / 360.0
    last = int(-2 * start * per_degree) - 1
    return F.least(F.greatest(F.floor((value - start) * per_degree), F.lit(0)), F.lit(last))


def cell_xy(lon: Column, lat: Column, res: int) -> tuple[Column, Column]:
    return _axis_cell(lon, -180.0, res), _axis_cell(lat, -90.0, res)


def pack_cell(x: Column, y: Column, res: int) -> Column:
    return F.lit(res).cast("long") * (1 << 2 * AXIS_BITS) + x * (1 << AXIS_BITS) + y


def cell_of(lon: Column, lat: Column, res: int) -> Column:
    x, y = cell_xy(lon, lat, res)
    return pack_cell(x, y, res)


def parent_cell(cell: Column, steps: int = 1) -> Column:
    """The cell that holds this one, `steps` resolutions up."""
    mask = (1 << AXIS_BITS) - 1
    res = F.shiftright(cell, 2 * AXIS_BITS)
    x = F.shiftright(cell, AXIS_BITS).bitwiseAND(mask)
    y = cell.bitwiseAND(mask)
    return (res - steps) * (1 << 2 * AXIS_BITS) + F.shiftright(x, steps) * (1 << AXIS_BITS) + F.shiftright(y, steps)


def cell_span(low: Column, high: Column, start: float, res: int) -> Column:
    """All cell numbers along an axis from `start` to -start degrees, from low to high degrees: as many as the axis has at most."""
    return F.sequence(_axis_cell(low, start, res), _axis_cell(high, start, res))


def cells_around(lon: Column, lat: Column, metres: float, res: int) -> Column:
    """The cells that any point within `metres` of a place can be in (not across the date line)."""
    dy = F.lit(metres / METRES_PER_DEGREE * 1.000001)
    dx = dy / F.cos(F.radians(F.least(F.abs(lat) + dy, F.lit(89.9))))
    rows = cell_span(lat - dy, lat + dy, -90.0, res)
    across = F.transform(cell_span(lon - dx, lon + dx, -180.0, res), lambda x: F.transform(rows, lambda y: pack_cell(x, y, res)))
    return F.flatten(across)


def cell_centre(cell: Column, res: int) -> tuple[Column, Column]:
    """lon and lat of the middle of a cell."""
    mask, side = (1 << AXIS_BITS) - 1, 360.0 / (1 << (res + BASE_BITS))
    x, y = F.shiftright(cell, AXIS_BITS).bitwiseAND(mask), cell.bitwiseAND(mask)
    return (x + 0.5) * side - 180.0, (y + 0.5) * side - 90.0


def cell_ring(x: Column, y: Column, res: int) -> Column:
    """The nine cells around (x, y), itself included."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return F.transform(steps, lambda s: pack_cell(x + s["i"], y + s["j"], res))


def cell_boundary(cell: Column) -> Column:
    """Closed ring of (lon, lat) corners."""
    mask = (1 << AXIS_BITS) - 1
    res = F.shiftright(cell, 2 * AXIS_BITS)
    side = F.lit(360.0) / F.pow(F.lit(2.0), res + BASE_BITS)
    x, y = F.shiftright(cell, AXIS_BITS).bitwiseAND(mask), cell.bitwiseAND(mask)
    corner = lambda i, j: F.array((x + i) * side - 180.0, (y + j) * side - 90.0)
    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))


def h3_parent(cell: Column, res: int) -> Column:
    """Parent of an H3 id (as a long) at a coarser resolution: the resolution field is set, finer digits become 7s."""
    field = F.lit(15 << 52)
    return cell.bitwiseAND(F.bitwise_not(field)).bitwiseOR(F.lit(res << 52)).bitwiseOR(F.lit((1 << (3 * (15 - res))) - 1))


def h3_string(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def h3_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def metres_between(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance."""
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def metres_to_segment(lon: Column, lat: Column, ax: Column, ay: Column, bx: Column, by: Column, plane: Column | None = None) -> Column:
    """Distance of a point from the segment a-b on the plane at the point's latitude, or at another."""
    k = F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat if plane is None else plane))
    x1, y1 = (ax - lon) * k, (ay - lat) * METRES_PER_DEGREE
    dx, dy = (bx - ax) * k, (by - ay) * METRES_PER_DEGREE
    norm = dx * dx + dy * dy
    t = F.when(norm > 0, F.least(F.greatest(-(x1 * dx + y1 * dy) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    px, py = x1 + t * dx, y1 + t * dy
    return F.sqrt(px * px + py * py)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting: whether the point is inside a ring, array<struct<x, y>> (closed or not)."""
    n = F.size(ring)

    def crosses(k: Column) -> Column:
        a, b = F.get(ring, k), F.get(ring, F.pmod(k + 1, n))
        over = (a["y"] > lat) != (b["y"] > lat)
        at = (b["x"] - a["x"]) * (lat - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(over & (lon < at), 1).otherwise(0)

    hits = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, x: s + x)
    return F.pmod(hits, F.lit(2)) == 1


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of a closed ring's corners, the repeated last one left out."""
    corners = F.slice(ring, F.lit(1), F.size(ring) - 1)
    mean = lambda f: F.aggregate(F.transform(corners, f), F.lit(0.0), lambda s, x: s + x) / F.size(corners)
    return mean(lambda p: p["x"]), mean(lambda p: p["y"])


def wkb_point(wkb: Column) -> tuple[Column, Column]:
    """lon and lat of a little-endian WKB point, read in Arrow batches; null for null or short bytes."""
    @F.pandas_udf("lon double, lat double")
    def decode(values: pd.Series) -> pd.DataFrame:
        rows = [struct.unpack("<dd", bytes(v)[5:21]) if v is not None and len(v) >= 21 else (None, None) for v in values]
        return pd.DataFrame(rows, columns=["lon", "lat"], dtype="float64")

    point = decode(wkb)
    return point["lon"], point["lat"]


def wkb_kind(wkb: Column) -> Column:
    """The name of a little-endian WKB geometry's type; null for null, short or other bytes."""
    low = F.conv(F.hex(F.substring(wkb, 2, 1)), 16, 10).cast("int")
    sound = (F.octet_length(wkb) > 5) & (F.hex(F.substring(wkb, 1, 1)) == "01") & (F.hex(F.substring(wkb, 3, 3)) == "000000")
    names = F.array(*[F.lit(n) for n in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")])
    return F.when(sound, F.get(names, low - 1))


def wkb_is_empty(wkb: Column) -> Column:
    """Whether a WKB geometry has no parts: a count of zero, or a point of NaN coordinates."""
    point = F.hex(F.substring(wkb, 12, 2)).isin("F87F", "F8FF")
    return F.when(wkb_kind(wkb) == "Point", point).otherwise(F.hex(F.substring(wkb, 6, 4)) == "00000000")


def approx_reach(lon: Column, lat: Column, at_lon: float, at_lat: float, minutes: float, metres_per_minute: float = 1500.0, pad: float = 1.4) -> Column:
    """Whether a place may be reached from (at_lon, at_lat) in some minutes: a generous straight-line radius. Nothing is in no time."""
    if minutes <= 0:
        return F.lit(False)
    radius = minutes * metres_per_minute * pad
    dx = (lon - at_lon) * (max(math.cos(math.radians(at_lat)), 1e-4) * METRES_PER_DEGREE)
    dy = (lat - at_lat) * METRES_PER_DEGREE
    return dx * dx + dy * dy <= radius * radius


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point is in a box of two corners, given in any order."""
    x1, y1, x2, y2 = box
    return lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
