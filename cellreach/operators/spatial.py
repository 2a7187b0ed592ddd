"""Joins by place: nearest neighbours, nearest within a distance, point in polygon, corridors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.functions import geo, h3
from cellreach.operators.polygons import points_in, polyfill
from cellreach.plans.cuts import cut, spread


def _near_cells(points: DataFrame, metres: float, res: int) -> DataFrame:
    return points.withColumn("cell", F.explode(geo.cells_around(F.col("lon"), F.col("lat"), metres, res)))


def within(points: DataFrame, places: DataFrame, metres: float, res: int) -> DataFrame:
    """Pairs of points (id, lon, lat) and places (place, p_lon, p_lat) at most `metres` apart, with their distance.

    A point is joined with the places of all cells that the distance reaches, few if cells are about `metres` wide.
    An equi-join on the cell, so crowded cells are split by adaptive execution and no pair of far cells is made.
    """
    celled = places.withColumn("cell", geo.cell_of(F.col("p_lon"), F.col("p_lat"), res))
    pairs = _near_cells(points, metres, res).join(celled, "cell").drop("cell")
    return pairs.withColumn("dist", geo.metres_between(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat"))).where(
        F.col("dist") <= metres
    )


#: Places that the most crowded cell of a first round may hold, for each that is sought.
CROWD, FINEST = 4, 20
#: Points of a task, and segments.
ROWS, LINES = 50_000, 2_000


def _spots(points: DataFrame) -> DataFrame:
    """Where points are, once each: what is near a place does not depend on how many points are there."""
    return spread(points.select("lon", "lat"), ROWS, "lon", "lat").distinct()


def _least_places(places: DataFrame, k: int) -> DataFrame:
    """The k least places of every spot; others there can never be among the k nearest of anything."""
    rank = F.row_number().over(Window.partitionBy("p_lon", "p_lat").orderBy("place"))
    known = places.select("place", "p_lon", "p_lat").where("p_lon is not null and p_lat is not null")
    return known.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def _first_step(places: DataFrame, k: int, res: int) -> int:
    """By how many resolutions finer than res the cells must be, so that none holds more than CROWD times k places."""
    finest = geo.cell_of(F.col("p_lon"), F.col("p_lat"), FINEST)
    counts = places.groupBy(finest.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), geo.parent_cell(F.col("cell"), FINEST - res - j).alias("up")) for j in range(FINEST - res + 1)]))
    crowds = counts.select(levels.alias("x"), "n").groupBy("x.j", "x.up").agg(F.sum("n").alias("n")).groupBy("j").agg(F.max("n").alias("n"))
    fit = [r["j"] for r in crowds.collect() if r["n"] <= CROWD * k]  # a row per resolution
    return min(fit, default=FINEST - res)


def _knn_rounds(spots: DataFrame, places: DataFrame, k: int, steps: list[tuple[float, int]]) -> DataFrame:
    """(lon, lat, place, dist, rank): the k nearest places of every spot within the last of the growing distances (metres, resolution).

    A spot is done when k places are within a round's distance, so that crowded places are searched nearby only.
    """
    rank = F.row_number().over(Window.partitionBy("lon", "lat").orderBy("dist", "place"))
    done, left = [], spots
    for n, (metres, res) in enumerate(steps):
        near = within(left, places, metres, res).select("lon", "lat", "place", "dist").withColumn("rank", rank).where(F.col("rank") <= k)
        if n == len(steps) - 1:
            return reduce(DataFrame.unionByName, [*done, near])
        near = cut(near)
        full = near.where(F.col("rank") == k).select("lon", "lat")
        done.append(near.join(full, ["lon", "lat"], "left_semi"))
        left = cut(left.join(full, ["lon", "lat"], "left_anti"))
        if not left.head(1):
            return reduce(DataFrame.unionByName, done)


def _growing(places: DataFrame, k: int, metres: float, res: int) -> list[tuple[float, int]]:
    """Distances and resolutions that double up to (metres, res), from where no cell is crowded."""
    first = _first_step(places, k, res) if res < FINEST else 0
    return [(metres / 2**j, res + j) for j in range(first, -1, -1)]


def knn_join(points: DataFrame, places: DataFrame, k: int, metres: float, res: int) -> DataFrame:
    """The k nearest places of every point within `metres`, ties by place: (id, place, dist, rank from 1)."""
    few = _least_places(places, k)
    near = _knn_rounds(_spots(points), few, k, _growing(few, k, metres, res))
    return points.select("id", "lon", "lat").join(near, ["lon", "lat"]).select("id", "place", "dist", "rank")


def knn_any(points: DataFrame, places: DataFrame, k: int, metres: float = 1000.0, res: int = 13) -> DataFrame:
    """The k nearest places of every point however far they are, ties by place: (id, place, dist, rank from 1).

    Rounds that double the radius up to `metres` and then take four times the radius (and cells four times as wide): points that have k places within
    it are done. The last round takes in the whole plane; its points are those with fewer than k places anywhere, or k places further than any earlier radius.
    """
    few = _least_places(places, k)
    steps = _growing(few, k, metres, res)
    while metres * 4 <= 4e7 and res > 0:
        metres, res = metres * 4, max(res - 2, 0)
        steps.append((metres, res))
    steps[-1] = (1e8, 0)
    near = _knn_rounds(_spots(points), few, k, steps)
    return points.select("id", "lon", "lat").join(near, ["lon", "lat"]).select("id", "place", "dist", "rank")


def snap_connected(candidates: DataFrame, factor: float = 2.0, enough: int = 2) -> DataFrame:
    """One place per id from kNN candidates (id, place, dist, score).

    The nearest, unless its score is under `enough` and a candidate within `factor` times its distance has enough: then the best score, ties to
    the nearest. score is the lesser of a node's in and out degree.
    """
    by_id = Window.partitionBy("id")
    near = candidates.withColumn("least", F.min("dist").over(by_id)).withColumn(
        "first_score", F.min_by("score", F.struct("dist", "place")).over(by_id)
    )
    usable = near.where(F.col("dist") <= factor * F.col("least"))
    change = (F.col("first_score") < enough) & (F.max("score").over(by_id) >= enough)
    order = F.struct(F.when(change, -F.col("score")).otherwise(F.lit(0)).alias("s"), "dist", "place")
    return usable.withColumn("order", order).groupBy("id").agg(F.min_by(F.struct("place", "dist", "score"), "order").alias("x")).select("id", "x.*")


def nearest_node(nodes: DataFrame, lon: float, lat: float) -> DataFrame:
    """The node (node, lon, lat) least far from a place; ties to the least node."""
    dist = geo.metres_between(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return nodes.agg(F.min(F.struct(dist.alias("dist"), "node")).alias("x")).select("x.node", "x.dist")


def nearest_by_priority(points: DataFrame, places: DataFrame, limits: list[tuple[str, float]], res: int) -> DataFrame:
    """(id, kind): the first kind, in the order of limits, with a place (place, p_lon, p_lat, kind) within its distance; else 'other'.

    A kind is within its distance where its nearest place is: one place a spot is looked for, of each kind in turn, for the spots that are left.
    """
    left, hits = _spots(points), []
    for kind, metres in limits:
        own = _least_places(places.where(F.col("kind") == kind), 1)
        hit = cut(_knn_rounds(left, own, 1, _growing(own, 1, metres, res)).select("lon", "lat").withColumn("kind", F.lit(kind)))
        hits.append(hit)
        left = cut(left.join(hit, ["lon", "lat"], "left_anti"))
    best = reduce(DataFrame.unionByName, hits)
    return points.select("id", "lon", "lat").join(best, ["lon", "lat"], "left").select("id", F.coalesce("kind", F.lit("other")).alias("kind"))


def _box_cells(df: DataFrame, lo_x, hi_x, lo_y, hi_y, res: int) -> DataFrame:
    """df with a row per cell of the box, in two steps, so that no row carries more than one side of it."""
    rows = df.withColumn("_x", F.explode(geo.cell_span(lo_x, hi_x, -180.0, res)))
    rows = rows.withColumn("_y", F.explode(geo.cell_span(lo_y, hi_y, -90.0, res)))
    return rows.withColumn("cell", geo.pack_cell(F.col("_x"), F.col("_y"), res)).drop("_x", "_y")


def points_in_polygons(points: DataFrame, polygons: DataFrame, res: int = 6) -> DataFrame:
    """(id, poly) of points in polygons (poly, ring array<struct<x, y>>): an equi-join on cells that are inside as a whole or have a few edges.

    Choose cells smaller than the usual polygon.
    """
    return points_in(points, polygons.withColumn("rings", F.array("ring")), res).select("id", "poly")


def polyfill_cells(polygons: DataFrame, res: int) -> DataFrame:
    """(poly, cell) of the cells whose centre is in a polygon (poly, ring array<struct<x, y>>)."""
    return polyfill(polygons.withColumn("rings", F.array("ring")), res)


def dissolve(covered: DataFrame) -> DataFrame:
    """(cell) of the union of shapes given as covered cells (poly, cell)."""
    return covered.select("cell").distinct()


def corridor_cells(segments: DataFrame, metres: float, res: int) -> DataFrame:
    """(cell) of the dissolved buffers of segments (ax, ay, bx, by): cells whose centre is within `metres` of any."""
    x, y = [(F.least(f"a{a}", f"b{a}"), F.greatest(f"a{a}", f"b{a}")) for a in "xy"]
    dy = F.lit(metres / geo.METRES_PER_DEGREE * 1.000001)
    dx = dy / F.cos(F.radians(F.least(F.greatest(F.abs("ay"), F.abs("by")) + dy, F.lit(89.9))))
    keyed = _box_cells(segments, x[0] - dx, x[1] + dx, y[0] - dy, y[1] + dy, res)
    lon, lat = geo.cell_centre(F.col("cell"), res)
    return dissolve(keyed.where(geo.metres_to_segment(lon, lat, *[F.col(c) for c in ("ax", "ay", "bx", "by")]) <= metres))


def flag_cells(cells: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """cells (cell, ...) with a boolean: whether the cell is among the members (cell)."""
    hit = members.select("cell").distinct().withColumn("_in", F.lit(True))
    return cells.join(hit, "cell", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


#: Resolutions that cells along segments may be finer than asked for, and sides of them that a piece of a segment spans.
FINER, PIECE = 5, 8


def near_segments(points: DataFrame, segments: DataFrame, metres: float, res: int) -> DataFrame:
    """(id, near): whether a point is within `metres` of a segment (ax, ay, bx, by), whatever its length.

    Cells about `metres` wide at most, from pieces of segments: one that lies within the distance as a whole settles all its points; the others' points
    are tested against the segments that come near the cell.
    """
    ends = ["ax", "ay", "bx", "by"]
    res = min(max(res, math.ceil(math.log2(360 * geo.METRES_PER_DEGREE / max(metres, 1.0))) - geo.BASE_BITS), res + FINER)
    side = 360.0 / (1 << (res + geo.BASE_BITS))
    rows = spread(segments.select(*ends), LINES, *ends).distinct()
    count = F.greatest(F.lit(1.0), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / (PIECE * side))).cast("long")
    rows = rows.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (i / F.col("_n"))
    for c in "xy":
        p, q = at(f"a{c}", f"b{c}", F.col("_i")), at(f"a{c}", f"b{c}", F.col("_i") + 1)
        rows = rows.withColumns({f"_lo{c}": F.least(p, q), f"_hi{c}": F.greatest(p, q)})
    dy = F.lit(metres / geo.METRES_PER_DEGREE * 1.000001 + 1e-9)
    dx = dy / F.cos(F.radians(F.least(F.greatest(F.abs("_loy"), F.abs("_hiy")) + dy, F.lit(89.9))))
    rows = _box_cells(rows, F.col("_lox") - dx, F.col("_hix") + dx, F.col("_loy") - dy, F.col("_hiy") + dy, res).select("cell", *ends)
    # Distances are taken on the plane of the point's latitude: those of all points of a cell lie between those on the planes of its two borders.
    lon, lat = geo.cell_centre(F.col("cell"), res)
    wide, narrow = F.greatest(F.abs(lat) - side / 2, F.lit(0.0)), F.least(F.abs(lat) + side / 2, F.lit(90.0))
    half = lambda plane: F.lit(geo.METRES_PER_DEGREE * side / 2) * F.sqrt(F.pow(F.cos(F.radians(plane)), 2) + 1)
    off = lambda plane: geo.metres_to_segment(lon, lat, *[F.col(c) for c in ends], plane=plane)
    border = (F.abs(lon) + side >= 180) | (F.abs(lat) + side >= 90)  # what lies beyond the world is counted there
    # As aggregates, which evaluate what the distances share once.
    bounds = rows.groupBy("cell", *ends).agg(
        F.min(F.when(border, F.lit(math.inf)).otherwise(off(wide) + half(wide))).alias("most"),
        F.min(F.when(border, F.lit(0.0)).otherwise(off(narrow) - half(narrow))).alias("least"),
    )
    bounds = cut(bounds.where(F.col("least") <= metres * (1 + 1e-9) + 1e-6))
    whole = bounds.where(F.col("most") <= metres * (1 - 1e-9)).select("cell").distinct()
    some = bounds.select("cell", *ends).join(whole, "cell", "left_anti")
    spots = _spots(points).withColumn("cell", geo.cell_of(F.col("lon"), F.col("lat"), res))
    close = geo.metres_to_segment(*[F.col(c) for c in ("lon", "lat", *ends)]) <= metres
    hit = spots.join(whole, "cell", "left_semi").select("lon", "lat").unionByName(spots.join(some, "cell").where(close).select("lon", "lat").distinct())
    hit = hit.withColumn("near", F.lit(True))
    return points.select("id", "lon", "lat").join(hit, ["lon", "lat"], "left").select("id", F.coalesce("near", F.lit(False)).alias("near"))


def zonal_mean(pixels: DataFrame, res: int, grid: str = "square") -> DataFrame:
    """(cell, n, mean) of pixels (lon, lat, value) by the cell of their middle, on the square grid or H3; null values are no data."""
    cell_of = h3.h3_cell if grid == "h3" else geo.cell_of
    return (
        pixels.where("value is not null")
        .groupBy(cell_of(F.col("lon"), F.col("lat"), res).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    )
