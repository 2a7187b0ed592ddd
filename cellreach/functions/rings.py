"""Polygons as rings: making them valid, and points that surely lie inside; numpy in Arrow batches.

Rings are array<array<struct<x, y>>> and count together by the even-odd rule. Rings with fewer than three different corners, and corners
with null or non-finite coordinates, are left out; null stays null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x: double, y: double>>>"
#: Pairs of sides that are compared at once.
BLOCK = 1 << 20
#: Sides whose directions differ by less (the sine between them) lie one way.
PARALLEL = 1e-12
#: Up to so many sides plain numbers are quicker than arrays.
FEW = 24


def corners_of(rings) -> list[np.ndarray]:
    """Rings as arrays of corners, without the repeated last one and without corners that repeat the one before."""
    out = []
    for ring in rings if rings is not None else ():
        xy = np.array([(p["x"], p["y"]) for p in (ring if ring is not None else ()) if p is not None and p["x"] is not None and p["y"] is not None], float).reshape(-1, 2)
        xy = xy[np.isfinite(xy).all(1)]
        if len(xy):
            xy = xy[(xy != np.concatenate([xy[-1:], xy[:-1]])).any(1)] if len(xy) > 1 else xy[:0]
        if len(xy) > 2:
            out.append(xy)
    return out


def _next(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a[1:], a[:1]])


def _area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * _next(y) - _next(x) * y).sum() / 2)


def _cuts(e: np.ndarray) -> list[list[tuple[float, float, float]]]:
    """Of each side (x1, y1, x2, y2) the places (share of it, x, y) where another one meets it, ends that lie on it included."""
    if len(e) <= FEW:
        return _few_cuts(e.tolist())
    a, b = e[:, :2], e[:, 2:]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    out: list[list[tuple[float, float, float]]] = [[] for _ in e]
    for k in range(0, len(e), max(1, BLOCK // len(e))):
        i = np.arange(k, min(k + max(1, BLOCK // len(e)), len(e)))
        meet = ((lo[i, None] <= hi[None]) & (hi[i, None] >= lo[None])).all(2) & (np.arange(len(e))[None] > i[:, None])
        p, q = np.nonzero(meet)
        p = p + k
        d, f, w = b[p] - a[p], b[q] - a[q], a[q] - a[p]
        cross = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            s, t = (w[:, 0] * f[:, 1] - w[:, 1] * f[:, 0]) / cross, (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / cross
        one_way = np.abs(cross) <= PARALLEL * np.hypot(*d.T) * np.hypot(*f.T)
        ok = ~one_way & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        for x, u, y, v, point in zip(p[ok].tolist(), s[ok].tolist(), q[ok].tolist(), t[ok].tolist(), (a[p[ok]] + s[ok, None] * d[ok]).tolist(), strict=True):
            out[x].append((u, *point))
            out[y].append((v, *point))
        for x, y in zip(p[one_way].tolist(), q[one_way].tolist(), strict=True):
            for side, other in ((x, y), (y, x)):
                along = b[side] - a[side]
                for end in (a[other], b[other]):
                    v = end - a[side]
                    if abs(along[0] * v[1] - along[1] * v[0]) <= PARALLEL * np.hypot(*along) * np.hypot(*v) and 0 <= v @ along <= along @ along:
                        out[side].append((float(v @ along / (along @ along)), *end.tolist()))
    return out


def _few_cuts(e: list[list[float]]) -> list[list[tuple[float, float, float]]]:
    """The same, side by side."""
    out: list[list[tuple[float, float, float]]] = [[] for _ in e]
    for x, (ax, ay, bx, by) in enumerate(e):
        dx, dy = bx - ax, by - ay
        low_x, high_x, low_y, high_y = min(ax, bx), max(ax, bx), min(ay, by), max(ay, by)
        for y in range(x + 1, len(e)):
            cx, cy, gx, gy = e[y]
            if min(cx, gx) > high_x or max(cx, gx) < low_x or min(cy, gy) > high_y or max(cy, gy) < low_y:
                continue
            fx, fy, wx, wy = gx - cx, gy - cy, cx - ax, cy - ay
            cross = dx * fy - dy * fx
            if abs(cross) > PARALLEL * math.hypot(dx, dy) * math.hypot(fx, fy):
                s, t = (wx * fy - wy * fx) / cross, (wx * dy - wy * dx) / cross
                if 0 <= s <= 1 and 0 <= t <= 1:
                    at = ax + s * dx, ay + s * dy
                    out[x].append((s, *at))
                    out[y].append((t, *at))
                continue
            for side, other in ((x, y), (y, x)):
                px, py, qx, qy = e[side]
                lx, ly = qx - px, qy - py
                for ex, ey in (e[other][:2], e[other][2:]):
                    vx, vy = ex - px, ey - py
                    along = vx * lx + vy * ly
                    if abs(lx * vy - ly * vx) <= PARALLEL * math.hypot(lx, ly) * math.hypot(vx, vy) and 0 <= along <= lx * lx + ly * ly:
                        out[side].append((along / (lx * lx + ly * ly), ex, ey))
    return out


def _pieces(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and pairs of them: the sides cut wherever they meet; pieces that lie on each other an even number of times are none."""
    e = np.concatenate([np.concatenate([r, _next(r)], 1) for r in rings])
    grain = max(float(np.abs(e).max()), 1e-300) * 1e-13
    nodes: dict[tuple, int] = {}
    places: list[tuple] = []

    def node(x: float, y: float) -> int:
        key = round(x / grain), round(y / grain)
        if key not in nodes:
            nodes[key] = len(places)
            places.append((x, y))
        return nodes[key]

    count: dict[tuple[int, int], int] = {}
    for side, cuts in zip(e.tolist(), _cuts(e), strict=True):
        path = [node(*side[:2]), *[node(x, y) for _, x, y in sorted(cuts)], node(*side[2:])]
        for u, v in zip(path, path[1:], strict=False):
            if u != v:
                pair = min(u, v), max(u, v)
                count[pair] = count.get(pair, 0) + 1
    odd = [pair for pair, n in count.items() if n % 2]
    return np.array(places), np.array(odd, np.int64).reshape(-1, 2)


def _inside_left(places: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Pairs turned so that what is inside, by the even-odd rule, is on their left."""
    if len(pairs) <= 2 * FEW:
        return _few_inside_left(places.tolist(), pairs.tolist())
    a, b = places[pairs[:, 0]], places[pairs[:, 1]]
    flat = np.abs(b[:, 1] - a[:, 1]) < np.abs(b[:, 0] - a[:, 0])  # judged by a ray to the north, others by one to the east
    keep = np.empty(len(pairs), bool)
    for axis, some in ((1, np.flatnonzero(~flat)), (0, np.flatnonzero(flat))):
        for k in some.tolist():
            middle = (a[k] + b[k]) / 2
            over = (a[:, axis] > middle[axis]) != (b[:, axis] > middle[axis])
            over[k] = False
            p, q = a[over], b[over]
            at = (q[:, 1 - axis] - p[:, 1 - axis]) * (middle[axis] - p[:, axis]) / (q[:, axis] - p[:, axis]) + p[:, 1 - axis]
            beyond = bool((at > middle[1 - axis]).sum() % 2)  # whether the side that the ray goes to is inside
            rises = b[k, axis] > a[k, axis]
            # East is on the right of what goes north; north is on the left of what goes east.
            keep[k] = (beyond != rises) if axis == 1 else (beyond == rises)
    return np.where(keep[:, None], pairs, pairs[:, ::-1])


def _few_inside_left(places: list[list[float]], pairs: list[list[int]]) -> np.ndarray:
    """The same, pair by pair."""
    sides = [(*places[u], *places[v]) for u, v in pairs]
    out = []
    for k, (u, v) in enumerate(pairs):
        x1, y1, x2, y2 = sides[k]
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        east = not abs(y2 - y1) < abs(x2 - x1)
        n = 0
        for j, (px, py, qx, qy) in enumerate(sides):
            if not east:
                px, py, qx, qy = py, px, qy, qx
            at, beyond = (my, mx) if east else (mx, my)
            if j != k and (py > at) != (qy > at) and (qx - px) * (at - py) / (qy - py) + px > beyond:
                n += 1
        rises = y2 > y1 if east else x2 > x1
        keep = (n % 2 == 1) != rises if east else (n % 2 == 1) == rises
        out.append((u, v) if keep else (v, u))
    return np.array(out, np.int64).reshape(-1, 2)


def valid(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Closed simple rings of the same even-odd area: shells counter-clockwise, holes clockwise; they meet at corners at most."""
    if not rings:
        return []
    places, pairs = _pieces(rings)
    if not len(pairs):
        return []
    pairs = _inside_left(places, pairs)
    leave: dict[int, list[int]] = {}
    for k, u in enumerate(pairs[:, 0].tolist()):
        leave.setdefault(u, []).append(k)
    step = places[pairs[:, 1]] - places[pairs[:, 0]]
    heading = np.arctan2(step[:, 1], step[:, 0]).tolist()
    ends = pairs.tolist()
    free = [True] * len(ends)
    out = []
    for first in range(len(pairs)):
        if not free[first]:
            continue
        ring, k = [], first
        while free[k]:
            free[k] = False
            ring.append(ends[k][0])
            ways = [w for w in leave[ends[k][1]] if free[w] or w == first]
            if not ways:
                break
            # The sharpest turn to the left keeps areas that touch at a corner apart.
            k = max(ways, key=lambda w: (heading[w] - heading[k] + math.pi) % (2 * math.pi))  # noqa: B023
        # A corner that comes twice is where two rings touch.
        stack: list[int] = []
        for corner in [*ring, ring[0]]:
            if corner in stack:
                at = stack.index(corner)
                if len(stack) - at > 2:
                    out.append(places[[*stack[at:], corner]])
                del stack[at + 1 :]
            else:
                stack.append(corner)
    return sorted(out, key=lambda r: -abs(_area(r[:-1])))


def scan_point(rings: list[np.ndarray]) -> tuple[float, float] | None:
    """A point inside rings: the middle of the widest stretch of a horizontal line between corners, near mid-height."""
    if not rings:
        return None
    xy = np.concatenate(rings)
    heights = np.unique(xy[:, 1])
    if len(heights) < 2:
        return None
    middle = (heights[0] + heights[-1]) / 2
    above = min(np.searchsorted(heights, middle, "right"), len(heights) - 1)
    gaps = np.argsort(np.abs((heights[:-1] + heights[1:]) / 2 - middle), kind="stable")
    first = [above - 1] if above else []
    edges = np.concatenate([np.concatenate([r, _next(r)], 1) for r in rings])
    for k in [*first, *gaps[:64].tolist()]:
        y = (heights[k] + heights[k + 1]) / 2
        e = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
        x = np.sort((e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
        wide = x[1::2] - x[: len(x) // 2 * 2 : 2]
        if len(wide) and wide.max() > 0:
            at = int(wide.argmax())
            return float((x[2 * at] + x[2 * at + 1]) / 2), float(y)
    return None


def make_valid(rings: Column) -> Column:
    """Rings without crossings that hold the same places by the even-odd rule; null where nothing is left."""

    @F.pandas_udf(RINGS)
    def of(values: pd.Series) -> pd.Series:
        made = [valid(corners_of(v)) if v is not None else [] for v in values]
        return pd.Series([[[{"x": float(x), "y": float(y)} for x, y in r] for r in rows] if rows else None for rows in made], dtype=object)

    return of(rings)


def representative_point(rings: Column) -> tuple[Column, Column]:
    """x and y of a point inside; null where the rings hold no area."""

    @F.pandas_udf("x double, y double")
    def of(values: pd.Series) -> pd.DataFrame:
        points = [scan_point(corners_of(v)) if v is not None else None for v in values]
        return pd.DataFrame([p or (None, None) for p in points], columns=["x", "y"], dtype="float64")

    found = of(rings)
    return found["x"], found["y"]


def rings_area(rings: Column) -> Column:
    """Area on the plane by the signed sum of the rings: what make_valid gives counts as it should."""
    corner = lambda r, k: F.get(r, k)

    def one(r: Column) -> Column:
        cross = lambda k: corner(r, k)["x"] * corner(r, k + 1)["y"] - corner(r, k + 1)["x"] * corner(r, k)["y"]
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(r) - 2), cross), F.lit(0.0), lambda s, v: s + v) / 2

    return F.aggregate(F.transform(rings, one), F.lit(0.0), lambda s, v: s + v)
