"""Cells of polygons, and points in polygons, by descent through a hierarchy of cells.

A polygon starts at the roots of a grid. Each step splits the cells that an edge may touch, hands every child the edges near it alone, and
carries on whether its middle is inside: the middles of parent and child differ by the edges that the path between them crosses, all of which the parent
has. A cell without edges is inside or outside as a whole and needs no further test. So the work grows with the outline, not with the box; and no
row that is shuffled carries a ring, only the few edges of its cell.

Polygons are rows (id, rings): rings of one row count by the even-odd rule, so rings within rings are holes; rows of one id are parts, which are
united. Rings are array<array<struct<x, y>>>, closed or not. Places are compared on the plane of lon and lat; cells that reach over
the date line or a pole are tested against the polygon as a whole, so polygons given on either side of 180 degrees are covered.

Scale: the first stage takes a polygon a row as far down as its outline needs (SPREAD cells); those are dealt out again and finished in parallel, and whole
inside cells are expanded in pieces.

Defined results: null or empty rings, rings of fewer than three corners and corners with null or non-finite coordinates are left out; a null id is an id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.functions import geo, h3

#: Cells a polygon is split into before it is dealt out, and levels that one task expands an inside cell by at once.
SPREAD, EXPAND = 512, 5
_PIECE = "cell long, whole boolean, inside boolean, special boolean, edges array<double>"


class H3Grid:
    """Descent over H3 cells: a cell's box holds the middles of all that descend from it."""

    max_children = 7

    def roots(self) -> np.ndarray:
        return h3.base_cells()

    def level(self, ids: np.ndarray) -> np.ndarray:
        return h3.resolution(ids)

    def children(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h3.children(ids, int(h3.resolution(ids)[0]) + 1) if len(ids) else (ids, ids)

    def boxes(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """lon, lat of the middles and the half width and height of the boxes."""
        lon, lat = h3.centres(ids)
        # Children are 1 / sqrt 7 of the spacing away, theirs that much less, and so on.
        reach = h3.UNIT * 7 ** (-h3.resolution(ids) / 2) / (7**0.5 - 1) * 1.001
        ratio = np.sin(reach) / np.maximum(np.cos(np.radians(lat)), 1e-12)
        dx = np.where(ratio < 1, np.degrees(np.arcsin(np.minimum(ratio, 1))), 180.0)
        return lon, lat, dx, np.degrees(reach)


class SquareGrid:
    """Descent over the square grid of `geo`; boxes are the cells themselves."""

    max_children = 4

    def roots(self) -> np.ndarray:
        x, y = np.meshgrid(np.arange(1 << geo.BASE_BITS), np.arange(1 << (geo.BASE_BITS - 1)), indexing="ij")
        return ((x << geo.AXIS_BITS) + y).ravel()

    def level(self, ids: np.ndarray) -> np.ndarray:
        return ids >> (2 * geo.AXIS_BITS)

    def _split(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (1 << geo.AXIS_BITS) - 1
        return (ids >> geo.AXIS_BITS) & mask, ids & mask

    def children(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self._split(ids)
        level = (self.level(ids) + 1) << (2 * geo.AXIS_BITS)
        made = [level + ((2 * x + i) << geo.AXIS_BITS) + 2 * y + j for i in (0, 1) for j in (0, 1)]
        return np.stack(made, 1).ravel(), np.repeat(np.arange(len(ids)), 4)

    def boxes(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        x, y = self._split(ids)
        side = 360.0 / (1 << geo.BASE_BITS) / (2.0 ** self.level(ids))
        return (x + 0.5) * side - 180.0, (y + 0.5) * side - 90.0, side / 2, side / 2


@dataclass
class _Cells:
    """Cells of one level with the edges near each (rows of `edges` from first on, count of them)."""

    ids: np.ndarray
    inside: np.ndarray  # whether the middle is
    special: np.ndarray  # tested against all edges, as its box reaches over the date line or a pole
    first: np.ndarray
    count: np.ndarray
    edges: np.ndarray  # x1, y1, x2, y2


def _over(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Where the line of an edge is at height y, for edges that cross that height; else NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((e[:, 1] > y) != (e[:, 3] > y), (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0], np.nan)


def rays(x: np.ndarray, y: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether the ray from (x, y) to the east crosses each edge."""
    return _over(x, y, e) > x


def paths(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether the path from (x0, y0) east or west to x1 and then north or south to y1 crosses each edge an odd number of times."""
    at = _over(x0, y0, e)
    along = (at > x0) != (at > x1)
    flipped = e[:, [1, 0, 3, 2]]
    at = _over(y0, x1, flipped)
    return along ^ ((at > y0) != (at > y1))


def _near(lon: np.ndarray, lat: np.ndarray, dx: np.ndarray, dy: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Whether each edge meets the box: their extents overlap, and the box is not on one side of the edge's line."""
    dx, dy = dx * (1 + 1e-9) + 1e-12, dy * (1 + 1e-9) + 1e-12
    hit = (np.minimum(e[:, 0], e[:, 2]) <= lon + dx) & (np.maximum(e[:, 0], e[:, 2]) >= lon - dx)
    hit &= (np.minimum(e[:, 1], e[:, 3]) <= lat + dy) & (np.maximum(e[:, 1], e[:, 3]) >= lat - dy)
    away = (e[:, 2] - e[:, 0]) * (lat - e[:, 1]) - (e[:, 3] - e[:, 1]) * (lon - e[:, 0])
    return hit & (np.abs(away) <= np.abs(e[:, 2] - e[:, 0]) * dy + np.abs(e[:, 3] - e[:, 1]) * dx)


def _pairs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every cell's rows."""
    cell = np.repeat(np.arange(len(count)), count)
    return cell, np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count) + first[cell]


def _placed(grid, ids: np.ndarray, parents: _Cells | None, parent: np.ndarray, all_edges: np.ndarray) -> tuple[_Cells, np.ndarray]:
    """Cells with their edges, given those of their parents (None: they are roots); and whether an edge is near."""
    lon, lat, dx, dy = grid.boxes(ids)
    special = (lon + dx > 180 + 1e-9) | (lon - dx < -180 - 1e-9) | (lat + dy > 90 + 1e-9) | (lat - dy < -90 - 1e-9)
    n = len(ids)
    fresh = np.ones(n, bool) if parents is None else parents.special[parent]
    inside = np.zeros(n, bool)
    kept = [np.empty((0, 4))]
    owner = [np.empty(0, np.int64)]
    some = np.flatnonzero(fresh)
    for k in range(0, len(some), max(1, (1 << 20) // max(len(all_edges), 1))):
        part = some[k : k + max(1, (1 << 20) // max(len(all_edges), 1))]
        cell, row = np.repeat(part, len(all_edges)), np.tile(np.arange(len(all_edges)), len(part))
        e = all_edges[row]
        inside[part] = np.bincount(cell, rays(lon[cell], lat[cell], e), n)[part] % 2 == 1
        hit = _near(lon[cell], lat[cell], dx[cell], dy[cell], e) & ~special[cell]
        kept.append(e[hit])
        owner.append(cell[hit])
    rest = np.flatnonzero(~fresh)
    if len(rest):
        p = parent[rest]
        cell, row = _pairs(parents.first[p], parents.count[p])
        cell, e = rest[cell], parents.edges[row]
        p_lon, p_lat = grid.boxes(parents.ids)[:2]
        odd = np.bincount(cell, paths(p_lon[parent[cell]], p_lat[parent[cell]], lon[cell], lat[cell], e), n) % 2 == 1
        inside[rest] = parents.inside[p] ^ odd[rest]
        hit = _near(lon[cell], lat[cell], dx[cell], dy[cell], e) & ~special[cell]
        kept.append(e[hit])
        owner.append(cell[hit])
    edges, cell = np.concatenate(kept), np.concatenate(owner)
    order = np.argsort(cell, kind="stable")
    count = np.bincount(cell, minlength=n)
    if special.any():
        # Cells over the date line or a pole that the polygon's box does not reach, moved round by a turn or not, are as outside as their middles.
        lo, hi = np.minimum(all_edges[:, :2], all_edges[:, 2:]).min(0), np.maximum(all_edges[:, :2], all_edges[:, 2:]).max(0)
        meets = np.zeros(n, bool)
        polar = np.abs(lat) + dy > 90
        for turn in (-360, 0, 360):
            meets |= (lon + turn + dx >= lo[0]) & (lon + turn - dx <= hi[0])
        meets = (meets | polar) & (lat + dy >= lo[1]) & (lat - dy <= hi[1])
        border = np.where(special, meets, count > 0)
    else:
        border = count > 0
    return _Cells(ids, inside, special & border, np.cumsum(count) - count, count, edges[order]), border


def _taken(cells: _Cells, which: np.ndarray) -> _Cells:
    return _Cells(cells.ids[which], cells.inside[which], cells.special[which], cells.first[which], cells.count[which], cells.edges)


def _whole(grid, ids: np.ndarray, res: int, levels: int) -> list[np.ndarray]:
    """Inside cells expanded by some levels at most, towards res."""
    out = []
    while len(ids):
        level = int(grid.level(ids)[0])
        if level >= res or levels == 0:
            out.append(ids)
            break
        ids, levels = grid.children(ids)[0], levels - 1
    return out


def _descend(grid, cells: _Cells, border: np.ndarray, all_edges: np.ndarray, res: int, enough: int):
    """(inside cells by level, border cells, whether those are of resolution res): until then, or until border cells are enough."""
    wholes = [cells.ids[~border & cells.inside]]
    cells = _taken(cells, border)
    while len(cells.ids) and int(grid.level(cells.ids)[0]) < res and len(cells.ids) < enough:
        kids, parent = grid.children(cells.ids)
        placed, near = _placed(grid, kids, cells, parent, all_edges)
        if int(grid.level(kids)[0]) == res:
            return wholes, placed, True, near
        wholes.append(kids[~near & placed.inside])
        cells = _taken(placed, near)
    return wholes, cells, False, None


def edges_of(rings) -> np.ndarray:
    """x1, y1, x2, y2 of the sides of rings of {x, y}."""
    out = []
    for ring in rings or ():
        corners = np.array([(p["x"], p["y"]) for p in ring or () if p is not None and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2)
        corners = corners[np.isfinite(corners).all(1)]
        if len(corners) > 1 and (corners[0] == corners[-1]).all():
            corners = corners[:-1]
        if len(corners) > 2:
            out.append(np.concatenate([corners, np.roll(corners, -1, 0)], 1))
    return np.concatenate(out) if out else np.empty((0, 4))


def _batch(keys: pa.Array, rows: list[tuple], at: list[int]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.float64())]
    columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], names=["key", "cell", "whole", "inside", "special", "edges"])


def _pieces(polygons: DataFrame, id_col: str, rings_col: str, grid, res: int) -> DataFrame:
    """(key, cell, whole, inside, special, edges): cells that are inside as a whole, and cells with the edges near them; of the whole polygon once, dealt out."""
    kind = polygons.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for k, rings in enumerate(batch.column(1)):
                edges = edges_of(rings.as_py())
                if not len(edges):
                    continue
                roots = grid.roots()
                placed, border = _placed(grid, roots, None, np.zeros(len(roots), np.int64), edges)
                if int(grid.level(roots)[0]) == res:
                    wholes, cells, done, near = [], placed, True, border
                else:
                    wholes, cells, done, near = _descend(grid, placed, border, edges, res, SPREAD)
                for ids in wholes:
                    for some in _whole(grid, ids, max(res - EXPAND, 0), 99):
                        rows += [(int(c), True, True, False, []) for c in some]
                for j, c in enumerate(cells.ids.tolist()):
                    special = bool(cells.special[j])
                    own = edges if special else cells.edges[cells.first[j] : cells.first[j] + cells.count[j]]
                    if not done or near[j] or cells.inside[j]:
                        rows.append((c, bool(done and not near[j]), bool(cells.inside[j]), special, own.ravel()))
                at += [k] * (len(rows) - len(at))
                if len(rows) > 4096:
                    yield _batch(batch.column(0), rows, at)
                    rows, at = [], []
            if rows:
                yield _batch(batch.column(0), rows, at)

    source = polygons.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{rings_col}`").alias("rings"))
    return source.mapInArrow(run, f"key {kind}, {_PIECE}").repartition(F.xxhash64("cell", "key"))


def cover(polygons: DataFrame, grid, res: int, id_col: str = "poly", rings_col: str = "rings", by_centre: bool = False) -> DataFrame:
    """(id, cell, whole, inside, edges) of the cells of resolution res that polygons meet.

    A whole cell is inside altogether. Others have the edges near them and say whether their middle is inside. by_centre=True gives (id, cell) of the cells
    whose middle is inside.
    """
    kind = polygons.schema[id_col].dataType.simpleString()
    names = ["key", "cell"] if by_centre else ["key", "cell", "whole", "inside", "edges"]

    def finished(cell, whole, inside, special, edges):
        ids = np.array([cell], np.int64)
        if whole or int(grid.level(ids)[0]) == res:
            for some in _whole(grid, ids, res, 99):
                yield some, np.full(len(some), whole), np.full(len(some), inside), [edges] * len(some)
            return
        edges = edges.reshape(-1, 4)
        one = _Cells(ids, np.array([inside]), np.array([special]), np.zeros(1, np.int64), np.array([len(edges)]), edges)
        wholes, cells, done, near = _descend(grid, one, np.ones(1, bool), edges, res, 1 << 62)
        for ids in wholes:
            for some in _whole(grid, ids, res, 99):
                yield some, np.ones(len(some), bool), np.ones(len(some), bool), [edges[:0]] * len(some)
        if done:
            keep = np.flatnonzero(near | cells.inside)
            own = [edges if cells.special[j] else cells.edges[cells.first[j] : cells.first[j] + cells.count[j]] for j in keep]
            yield cells.ids[keep], ~near[keep], cells.inside[keep], own

    def run(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1, 5)]
            for k, (cell, whole, inside, special) in enumerate(zip(*columns, strict=True)):
                given = batch.column(5)[k].values.to_numpy()
                for ids, entire, middle, own in finished(cell, whole, inside, special, given):
                    if by_centre:
                        ids = ids[middle]
                        made = [pa.array(ids)]
                    else:
                        made = [pa.array(ids), pa.array(entire), pa.array(middle), pa.array([e.ravel() for e in own], pa.list_(pa.float64()))]
                    if len(ids):
                        keys = batch.column(0).take(pa.array(np.full(len(ids), k)))
                        yield pa.RecordBatch.from_arrays([keys, *made], names=names)

    ddl = f"key {kind}, cell long" + ("" if by_centre else ", whole boolean, inside boolean, edges array<double>")
    return _pieces(polygons, id_col, rings_col, grid, res).mapInArrow(run, ddl).withColumnRenamed("key", id_col)


def h3_polyfill(polygons: DataFrame, res: int, id_col: str = "poly", rings_col: str = "rings") -> DataFrame:
    """(id, cell) of the H3 cells whose middle is in a polygon; parts of one id are united."""
    return cover(polygons, H3Grid(), res, id_col, rings_col, by_centre=True).distinct()


def polyfill(polygons: DataFrame, res: int, id_col: str = "poly", rings_col: str = "rings") -> DataFrame:
    """(id, cell) of the square cells whose middle is in a polygon; parts of one id are united."""
    return cover(polygons, SquareGrid(), res, id_col, rings_col, by_centre=True).distinct()


def points_in(points: DataFrame, polygons: DataFrame, res: int, id_col: str = "poly", rings_col: str = "rings") -> DataFrame:
    """points (lon, lat, ...) with the id of every polygon that they are in, by the cells of the square grid.

    A point in a whole cell is inside; one in another cell is inside as its middle is, but for the edges on the path between them. A point in several
    parts of an id comes once.
    """
    parts = bool(polygons.groupBy(F.col(f"`{id_col}`")).count().where("count > 1").head(1))
    cells = cover(polygons, SquareGrid(), res, id_col, rings_col).withColumnRenamed("cell", "_cell")
    x, y = geo.cell_centre(F.col("_cell"), res)
    celled = points.where("lon between -180 and 180 and lat between -90 and 90").withColumns({"_cell": geo.cell_of(F.col("lon"), F.col("lat"), res), "_row": F.monotonically_increasing_id()})
    near = celled.join(cells, "_cell")
    e = F.col("edges")

    def crossed(k):
        x1, y1, x2, y2 = (F.get(e, 4 * k + j) for j in range(4))
        at = (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
        along = ((y1 > y) != (y2 > y)) & ((at > x) != (at > F.col("lon")))
        up = (y2 - y1) * (F.col("lon") - x1) / F.nullif(x2 - x1, F.lit(0.0)) + y1
        across = ((x1 > F.col("lon")) != (x2 > F.col("lon"))) & ((up > y) != (up > F.col("lat")))
        return F.when(along != across, 1).otherwise(0)

    sides = F.transform(F.sequence(F.lit(0), F.expr("size(edges) div 4 - 1").cast("int")), crossed)
    odd = F.when(F.size(e) > 0, F.aggregate(sides, F.lit(0), lambda s, v: s + v) % 2 == 1).otherwise(F.lit(False))
    inside = near.where(F.col("whole") | (F.col("inside") != odd))
    inside = inside.dropDuplicates(["_row", id_col]) if parts else inside
    return inside.select(*points.columns, id_col)


@dataclass(frozen=True)
class RasterGrid:
    """Pixels of a raster as the cells of the last level of a hierarchy; ids are row and column, of blocks of pixels above that level."""

    west: float
    north: float
    width: float  # of a pixel, in degrees
    height: float
    columns: int
    rows: int

    max_children = 4

    @property
    def depth(self) -> int:
        return max(self.columns - 1, self.rows - 1, 1).bit_length()

    def roots(self) -> np.ndarray:
        return np.zeros(1, np.int64)

    def level(self, ids: np.ndarray) -> np.ndarray:
        return ids >> 56

    def row_col(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (ids >> 28) & ((1 << 28) - 1), ids & ((1 << 28) - 1)

    def children(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = self.row_col(ids)
        level = self.level(ids) + 1
        r, c = (np.stack([2 * x + k for k in ks], 1) for x, ks in ((row, (0, 0, 1, 1)), (col, (0, 1, 0, 1))))
        span = 1 << (self.depth - level)[:, None]
        inside = (r * span < self.rows) & (c * span < self.columns)
        return ((level[:, None] << 56) | (r << 28) | c)[inside], np.repeat(np.arange(len(ids)), inside.sum(1))

    def boxes(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        row, col = self.row_col(ids)
        span = 2.0 ** (self.depth - self.level(ids))
        return self.west + (col + 0.5) * span * self.width, self.north - (row + 0.5) * span * self.height, span * self.width / 2, span * self.height / 2


#: A polygon whose box holds no more pixels is tested against each of them, together with the others of its batch.
FEW_PIXELS = 256


def _touched_few(rings: list, grid: RasterGrid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polygon, row, col) of the pixels that polygons of few pixels touch, and which polygons have too many."""
    sides = [edges_of(r) for r in rings]
    count = np.array([len(e) for e in sides])
    edges = np.concatenate([*sides, np.empty((0, 4))])
    owner = np.repeat(np.arange(len(sides)), count)
    lo = np.full((len(sides), 2), np.inf)
    hi = np.full((len(sides), 2), -np.inf)
    np.minimum.at(lo, owner, np.minimum(edges[:, :2], edges[:, 2:]))
    np.maximum.at(hi, owner, np.maximum(edges[:, :2], edges[:, 2:]))
    # A touch from outside counts, so pixels that end at the box do too.
    clip = lambda x, n: np.clip(np.nan_to_num(x, posinf=1e15, neginf=-1e15), -1, n)
    c0, c1 = (clip((x - grid.west) / grid.width, grid.columns + 1) for x in (lo[:, 0], hi[:, 0]))
    r0, r1 = (clip((grid.north - y) / grid.height, grid.rows + 1) for y in (hi[:, 1], lo[:, 1]))
    c0, r0 = (np.maximum(np.ceil(x - 1e-9) - 1, 0).astype(np.int64) for x in (c0, r0))
    c1, r1 = (np.minimum(np.floor(x + 1e-9), n - 1).astype(np.int64) for x, n in ((c1, grid.columns), (r1, grid.rows)))
    n = np.where(count > 0, np.maximum(c1 - c0 + 1, 0) * np.maximum(r1 - r0 + 1, 0), 0)
    many = n > FEW_PIXELS
    n = np.where(many, 0, n)
    poly = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(poly)) - np.repeat(np.cumsum(n) - n, n)
    wide = np.maximum(c1 - c0 + 1, 1)[poly]
    row, col = r0[poly] + k // wide, c0[poly] + k % wide
    pixel, at = _pairs((np.cumsum(count) - count)[poly], count[poly])
    x, y = grid.west + (col + 0.5) * grid.width, grid.north - (row + 0.5) * grid.height
    e = edges[at]
    half = [np.full(len(pixel), s / 2) for s in (grid.width, grid.height)]
    near = np.bincount(pixel, _near(x[pixel], y[pixel], *half, e), len(poly)) > 0
    inside = np.bincount(pixel, rays(x[pixel], y[pixel], e), len(poly)) % 2 == 1
    keep = near | inside
    return poly[keep], row[keep], col[keep], many


def touched_pixels(polygons: DataFrame, grid: RasterGrid, id_col: str = "poly", rings_col: str = "rings") -> DataFrame:
    """(id, row, col) of every pixel of a raster that a polygon touches, be it at a corner; parts of an id are united."""
    kind = polygons.schema[id_col].dataType.simpleString()

    def few(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                poly, row, col, _ = _touched_few(part.column(1).to_pylist(), grid)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(poly)), pa.array(row), pa.array(col)], names=["key", "row", "col"])

    def crowded(batches):
        for batch in batches:
            many = np.concatenate([_touched_few(batch.column(1).slice(lo, 1024).to_pylist(), grid)[3] for lo in range(0, len(batch), 1024)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(many))

    rings_kind = polygons.schema[rings_col].dataType.simpleString()
    source = polygons.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{rings_col}`").alias("rings"))
    large = cover(source.mapInArrow(crowded, f"key {kind}, rings {rings_kind}"), grid, grid.depth, "key")
    pixel = F.col("cell").bitwiseAND((1 << 56) - 1)
    found = source.mapInArrow(few, f"key {kind}, row long, col long").unionByName(
        large.select("key", F.shiftright(pixel, 28).alias("row"), pixel.bitwiseAND((1 << 28) - 1).alias("col"))
    )
    return found.distinct().withColumnRenamed("key", id_col)


def zonal_mean_touched(polygons: DataFrame, pixels: DataFrame, grid: RasterGrid, id_col: str = "poly", rings_col: str = "rings", no_data: float = -9999.0) -> DataFrame:
    """(id, n, mean) of the values of all pixels (row, col, value) that a polygon touches.

    Null, NaN and no-data values do not count; a polygon without any other has n 0 and a null mean.
    """
    value = F.when(~F.isnan("value") & (F.col("value") != no_data), F.col("value"))
    held = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value.alias("value"))
    joined = touched_pixels(polygons, grid, id_col, rings_col).join(held.where("value is not null"), ["row", "col"])
    means = joined.groupBy(id_col).agg(F.count("value").alias("n"), F.avg("value").alias("mean")).withColumnRenamed(id_col, "_key")
    every = polygons.select(id_col).distinct()
    return every.join(means, every[id_col].eqNullSafe(means["_key"]), "left").select(id_col, F.coalesce("n", F.lit(0)).alias("n"), "mean")


def shares(covered: DataFrame, id_col: str = "poly", levels: int = 4) -> DataFrame:
    """(id, cell, share) of H3 cells of `cover`: the part of each cell that the polygon has, by the middles of the cells some levels below (2,401 by default)."""
    kind = covered.schema[id_col].dataType.simpleString()

    def run(batches):
        grid = H3Grid()
        for batch in batches:
            ids = batch.column("cell").to_numpy()
            share = np.array(batch.column("whole").to_pylist(), float)
            inside = batch.column("inside").to_pylist()
            for k in np.flatnonzero(share == 0).tolist():
                e = batch.column("edges")[k].values.to_numpy().reshape(-1, 4)
                own = ids[k : k + 1]
                x0, y0 = h3.centres(own)
                below, _ = h3.children(own, int(h3.resolution(own)[0]) + levels)
                x, y, *_ = grid.boxes(below)
                p, q = np.repeat(np.arange(len(x)), len(e)), np.tile(np.arange(len(e)), len(x))
                odd = np.bincount(p, paths(np.full(len(p), x0[0]), np.full(len(p), y0[0]), x[p], y[p], e[q]), len(x)) % 2 == 1
                share[k] = (odd != inside[k]).mean()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("cell"), pa.array(share)], names=["key", "cell", "share"])

    named = covered.select(F.col(f"`{id_col}`").alias("key"), "cell", "whole", "inside", "edges")
    return named.mapInArrow(run, f"key {kind}, cell long, share double").groupBy("key", "cell").agg(F.least(F.sum("share"), F.lit(1.0)).alias("share")).withColumnRenamed("key", id_col)


def cells_by_largest_share(polygons: DataFrame, res: int, id_col: str = "poly", rings_col: str = "rings") -> DataFrame:
    """(cell, id, share) of every H3 cell that a polygon meets: the polygon that has most of it, ties to the least id."""
    from cellreach.operators.tables import keep_first

    each = shares(cover(polygons, H3Grid(), res, id_col, rings_col), id_col).where("share > 0")
    return keep_first(each, ["cell"], [F.col("share").desc(), F.col(id_col)]).select("cell", id_col, "share")
