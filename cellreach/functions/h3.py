"""H3 cells of points, their centres and boundaries, in numpy for Arrow batches, and as Columns.

H3 puts a grid of hexagons on each face of an icosahedron by gnomonic projection. Here a place on a face is a complex number: the face's corners
are 2, 2w and 2w**2 (w a third of a turn), and cells of resolution 0 are one apart. A resolution multiplies distances by the square root of 7, every
odd one also turns the axes by TURN. Crossing an edge of a face is a turn and a shift of that number, so one small table made
from the corners replaces look-ups by face and coordinate; the twelve pentagons, at the corners, lack the sixth of a turn that holds their K axis.

Ids are longs. Null, NaN, infinite or out-of-range coordinates give null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid. Latitude and longitude of the middle of each face, in radians, and the azimuth of its first axis.
FACES = [
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
]
# Fixed values of the grid: of base cells 0 to 121 the home face, and i, j, k on it. Pentagons are those at 2, 0, 0.
HOMES = """
1 100, 2 110, 1 000, 2 100, 0 200, 1 110, 1 001, 2 000, 0 100, 2 010, 1 010, 1 011, 3 100, 3 110, 11 200, 4 100, 0 000, 6 010, 0 001, 2 011,
7 001, 2 001, 0 110, 6 001, 10 200, 6 000, 3 000, 11 100, 4 110, 3 010, 0 011, 4 000, 5 010, 0 010, 7 010, 11 110, 7 000, 10 100, 12 200, 6 101,
7 101, 4 001, 3 001, 3 011, 4 010, 6 100, 11 000, 8 001, 5 001, 14 200, 5 000, 12 100, 10 110, 4 011, 12 110, 7 100, 11 010, 10 000, 13 200, 10 001,
11 001, 9 010, 8 010, 6 200, 8 000, 9 001, 14 100, 5 101, 16 011, 8 101, 5 100, 12 000, 7 200, 12 010, 10 010, 9 000, 13 100, 16 001, 15 011, 15 010,
16 010, 14 110, 13 110, 5 200, 8 100, 14 000, 9 101, 14 001, 17 001, 12 001, 16 000, 17 011, 15 001, 16 101, 9 100, 15 000, 13 000, 8 200, 13 010, 17 101,
19 010, 14 010, 19 011, 17 010, 13 001, 17 000, 16 100, 9 200, 15 101, 15 100, 18 011, 18 001, 19 001, 17 100, 19 000, 18 010, 18 101, 19 200, 19 100, 18 000,
19 101, 18 100
"""

MAX_RES = 15
#: The turn of an odd resolution's axes, and the plane distance on a face of radius one between neighbours of resolution 0.
TURN, UNIT = float(np.arcsin(np.sqrt(3 / 28))), (3 - 5**0.5) / 2
THIRD = np.exp(2j * np.pi / 3)
CORNERS = 2 * THIRD ** np.arange(3)
EPS = 1e-9
#: The digits in the order of their directions, a sixth of a turn apart, from the first axis on.
AROUND = [4, 6, 2, 3, 1, 5]
K_AXIS, IK_AXIS = 1, 5
#: Steps along the first and second axis of each digit.
STEPS = np.array([(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)])
#: A parent's axes in its child's numbers: first for odd children, then for even ones.
DOWN = {1: np.array([[2, 1], [-1, 3]]), 0: np.array([[3, -1], [1, 2]])}


def xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Unit vectors of places in radians."""
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], -1)


class _Grid:
    """What follows from FACES and HOMES: the frames of the faces, how they join, and the base cell and turn of each place of a face."""

    def __init__(self):
        lat, lon, azimuth = np.array(FACES).T
        self.mid = xyz(lon, lat)
        north = np.stack([-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)], -1)
        east = np.stack([-np.sin(lon), np.cos(lon), np.zeros(20)], -1)
        self.right = np.cos(azimuth)[:, None] * north + np.sin(azimuth)[:, None] * east
        self.up = np.cross(self.mid, self.right)
        corner = np.stack([self.on_sphere(np.arange(20), np.full(20, z)) for z in CORNERS], 1)
        same = np.einsum("fax,gbx->fagb", corner, corner) > 1 - 1e-9
        self.beyond = np.zeros((20, 3), int)  # the face across the edge that is opposite a corner
        self.turn, self.shift = np.zeros((20, 3), complex), np.zeros((20, 3), complex)
        for f in range(20):
            for m in range(3):
                p, q = (m + 1) % 3, (m + 2) % 3
                g = next(g for g in range(20) if g != f and same[f, p, g].any() and same[f, q, g].any())
                to_p, to_q = CORNERS[same[f, p, g].argmax()], CORNERS[same[f, q, g].argmax()]
                self.beyond[f, m] = g
                self.turn[f, m] = (to_q - to_p) / (CORNERS[q] - CORNERS[p])
                self.shift[f, m] = to_p - self.turn[f, m] * CORNERS[p]
        homes = [h.split() for h in HOMES.replace("\n", " ").split(",")]
        self.home = np.array([int(f) for f, _ in homes])
        self.home_at = np.array([[int(c[0]) - int(c[2]), int(c[1]) - int(c[2])] for _, c in homes])
        self.pentagon = np.array([c == "200" for _, c in homes])
        self._places(corner)

    def on_sphere(self, face: np.ndarray, z: np.ndarray) -> np.ndarray:
        p = self.mid[face] + UNIT * (z.real[..., None] * self.right[face] + z.imag[..., None] * self.up[face])
        return p / np.linalg.norm(p, axis=-1, keepdims=True)

    def _places(self, corner: np.ndarray) -> None:
        """By face and place (both axes from -2 to 2): the base cell, the turns from the face's axes to its home's, and whether a face lies after the gap of a pentagon."""
        self.base = np.full((20, 5, 5), -1)
        self.turns = np.zeros((20, 5, 5), int)
        self.after_gap, self.before_gap = np.zeros((20, 5, 5), bool), np.zeros((20, 5, 5), bool)
        centre = self.on_sphere(self.home, axial(self.home_at))
        for f in range(20):
            for i in range(-2, 3):
                for j in range(-2, 3):
                    z, g, turned = complex(i + j * THIRD), f, 1 + 0j
                    out = [(z * np.conj(-CORNERS[m] / 2)).real - 1 for m in range(3)]
                    if abs(z) > 2 + EPS or sorted(out)[-2] > EPS:
                        continue
                    m = int(np.argmax(out))
                    if out[m] > EPS:
                        g, z, turned = self.beyond[f, m], self.turn[f, m] * z + self.shift[f, m], self.turn[f, m]
                    b = int((centre @ self.on_sphere(np.array(g), np.array(z))).argmax())
                    self.base[f, i, j] = b
                    if self.pentagon[b]:
                        own = 180 + 120 * (int(np.argmax(corner[f] @ centre[b])))
                        steps = self.steps_about(b, f)
                        at = 180 - 60 * steps
                        self.turns[f, i, j] = (at - own) // 60 % 6
                        self.after_gap[f, i, j], self.before_gap[f, i, j] = steps == 4, steps == 0
                    else:
                        home = self.home[b]
                        if g != home:
                            turned = turned * self.turn[g, int(np.flatnonzero(self.beyond[g] == home)[0])]
                        self.turns[f, i, j] = round(np.angle(turned) / (np.pi / 3)) % 6

    def steps_about(self, base: int, face: int) -> int:
        """How many faces clockwise around a pentagon `face` is from the pentagon's home."""
        f, m = int(self.home[base]), 0
        for steps in range(5):
            if f == face:
                return steps
            f, m = self.round_corner(f, m, clockwise=True)
        raise ValueError("the face does not touch the cell")

    def round_corner(self, face: int, m: int, clockwise: bool) -> tuple[int, int]:
        """The next face around corner m of a face, and which corner of it that is."""
        edge = (m + 2) % 3 if clockwise else (m + 1) % 3
        z = self.turn[face, edge] * CORNERS[m] + self.shift[face, edge]
        return int(self.beyond[face, edge]), int(np.abs(CORNERS - z).argmin())


@lru_cache(maxsize=1)
def grid() -> _Grid:
    return _Grid()


def axial(ij: np.ndarray) -> np.ndarray:
    return ij[..., 0] + ij[..., 1] * THIRD


def _turned(digits: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Digits (rows of one cell each) after some sixths of a turn."""
    table = np.zeros((6, 7), np.int64)
    for t in range(6):
        for k, d in enumerate(AROUND):
            table[t, d] = AROUND[(k + t) % 6]
    return table[turns[:, None] % 6, digits]


def _leading(digits: np.ndarray) -> np.ndarray:
    """The first digit of each row that is not 0, or 0."""
    if not digits.shape[1]:
        return np.zeros(len(digits), np.int64)
    return digits[np.arange(len(digits)), (digits != 0).argmax(1)]


def cells(lon: np.ndarray, lat: np.ndarray, res: int) -> np.ndarray:
    """H3 ids of places in degrees; 0 where a place is none."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    sound = np.isfinite(lon) & np.isfinite(lat) & (np.abs(lat) <= 90)
    out = np.zeros(len(lon), np.int64)
    g, p = grid(), xyz(np.radians(lon[sound]), np.radians(lat[sound]))
    dots = p @ g.mid.T
    face = dots.argmax(1)
    away = dots[np.arange(len(p)), face] * UNIT
    z = ((p * g.right[face]).sum(1) + 1j * (p * g.up[face]).sum(1)) / away
    z = z * 7 ** (res / 2) * np.exp(-1j * TURN * (res % 2))
    # The nearest hexagon: round on three axes, and mend the one that was rounded most.
    r = z.imag / THIRD.imag
    q = z.real - r / 2
    s = -q - r
    rounded = [np.rint(a) for a in (q, r, s)]
    off = [np.abs(a - b) for a, b in zip(rounded, (q, r, s), strict=True)]
    q_worst, r_worst = (off[0] > off[1]) & (off[0] > off[2]), off[1] > off[2]
    q_int = np.where(q_worst, -rounded[1] - rounded[2], rounded[0]).astype(np.int64)
    r_int = np.where(~q_worst & r_worst, -rounded[0] - rounded[2], rounded[1]).astype(np.int64)
    at = np.stack([q_int + r_int, r_int], 1)
    digit_of = np.zeros((3, 3), np.int64)
    for d, (a, b) in enumerate(STEPS.tolist()):
        digit_of[a, b] = d
    digits = np.zeros((len(p), res), np.int64)
    for level in range(res, 0, -1):
        down = DOWN[level % 2]
        up = np.rint(at @ np.linalg.inv(down).T).astype(np.int64)
        step = at - up @ down.T
        digits[:, level - 1] = digit_of[step[:, 0], step[:, 1]]
        at = up
    base = g.base[face, at[:, 0], at[:, 1]]
    turns = g.turns[face, at[:, 0], at[:, 1]]
    # A pentagon's missing axis: what would fall there belongs to the neighbour on the side that the face is on.
    leading = _leading(_turned(digits, turns))
    missing = g.pentagon[base] & (leading == K_AXIS)
    turns = turns + np.where(missing & g.before_gap[face, at[:, 0], at[:, 1]], 1, np.where(missing, -1, 0))
    out[sound] = pack(base, _turned(digits, turns), res)
    return out


def pack(base: np.ndarray, digits: np.ndarray, res: int) -> np.ndarray:
    out = np.full(len(base), (1 << 59) | (res << 52), np.int64) | (base.astype(np.int64) << 45)
    for level in range(1, MAX_RES + 1):
        out |= (digits[:, level - 1] if level <= res else 7) << (3 * (MAX_RES - level))
    return out


def resolution(ids: np.ndarray) -> np.ndarray:
    return (ids >> 52) & 15


def digits_of(ids: np.ndarray, res: int) -> np.ndarray:
    return np.stack([(ids >> (3 * (MAX_RES - level))) & 7 for level in range(1, res + 1)], 1) if res else np.zeros((len(ids), 0), np.int64)


def is_cell(ids: np.ndarray) -> np.ndarray:
    """Whether longs are ids of cells: mode, base cell, digits up to the resolution and none after, no missing axis."""
    ids = np.asarray(ids, np.int64)
    g, res, base = grid(), resolution(ids), (ids >> 45) & 127
    ok = (ids > 0) & (ids >> 59 == 1) & ((ids >> 56) & 7 == 0) & (base < 122)
    digits = digits_of(ids, MAX_RES)
    inside = np.arange(1, MAX_RES + 1) <= res[:, None]
    ok &= (np.where(inside, digits < 7, digits == 7)).all(1)
    return ok & ~(g.pentagon[np.minimum(base, 121)] & (_leading(np.where(inside, digits, 0)) == K_AXIS))


def _cross(face: np.ndarray, z: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = grid()
    return g.beyond[face, edge], g.turn[face, edge] * z + g.shift[face, edge]


def _outside(z: np.ndarray) -> np.ndarray:
    """How far a place is beyond the edge opposite each corner; negative within."""
    return (z[..., None] * np.conj(-CORNERS / 2)).real - 1


def _settle(face: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie off their face, on the face where they are."""
    face, z = face.copy(), z.copy()
    for _ in range(3):
        out = _outside(z)
        off = np.flatnonzero(out.max(-1) > EPS)
        if not len(off):
            break
        face[off], z[off] = _cross(face[off], z[off], out[off].argmax(-1))
    return face, z


def _about_pentagon(base: np.ndarray, z: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places near a pentagon, in the plane of its home face, put on their faces: `angle` (degrees about the pentagon) says on which side of the gap they are."""
    g = grid()
    steps = np.floor((210 - angle) / 60 + EPS).astype(int)
    face, z, corner = g.home[base].copy(), z.copy(), np.zeros(len(base), int)
    for k in range(1, 6):
        for sign in (1, -1):
            todo = np.flatnonzero(sign * steps >= k)
            if len(todo):
                edge = (corner[todo] + (2 if sign > 0 else 1)) % 3
                at = CORNERS[corner[todo]]
                to, z[todo] = _cross(face[todo], z[todo], edge)
                _, moved = _cross(face[todo], at, edge)
                face[todo], corner[todo] = to, np.abs(CORNERS - moved[:, None]).argmin(1)
    return face, z


def _centres_of(ids: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Face and place of the middles of cells of one resolution."""
    g = grid()
    base, digits = (ids >> 45) & 127, digits_of(ids, res)
    fifth = g.pentagon[base]
    # The side before the gap is reached from the home face directly.
    digits = np.where((fifth & (_leading(digits) == IK_AXIS))[:, None], _turned(digits, np.full(len(ids), -1)), digits)
    at = g.home_at[base]
    for level in range(1, res + 1):
        at = at @ DOWN[level % 2].T + STEPS[digits[:, level - 1]]
    z = axial(at) * np.exp(1j * TURN * (res % 2)) / 7 ** (res / 2)
    face, place = _settle(g.home[base], z)
    near = np.flatnonzero(fifth & (np.abs(z - 2) > EPS))
    if len(near):
        angle = np.degrees(np.angle(z[near] - 2)) % 360
        lead = _leading(digits[near])
        angle = np.where((lead != K_AXIS) & (angle > 300), angle - 360, angle)
        face[near], place[near] = _about_pentagon(base[near], z[near], angle)
        face[near], place[near] = _settle(face[near], place[near])
    alone = np.flatnonzero(fifth & (np.abs(z - 2) <= EPS))
    face[alone], place[alone] = g.home[base[alone]], 2
    return face, place


def _degrees(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(p[..., 1], p[..., 0])), np.degrees(np.arcsin(np.clip(p[..., 2], -1, 1)))


def _by_resolution(ids: np.ndarray):
    """Positions of the sound ids of each resolution."""
    ok = is_cell(ids)
    for res in np.unique(resolution(ids[ok])).tolist():
        yield res, np.flatnonzero(ok & (resolution(ids) == res))


def centres(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lon and lat of the middles of cells; NaN for what is no cell."""
    ids = np.asarray(ids, np.int64)
    lon, lat = np.full(len(ids), np.nan), np.full(len(ids), np.nan)
    for res, which in _by_resolution(ids):
        lon[which], lat[which] = _degrees(grid().on_sphere(*_centres_of(ids[which], res)))
    return lon, lat


def boundaries(ids: np.ndarray) -> list[np.ndarray | None]:
    """Closed rings of (lon, lat); where a side crosses an edge of the icosahedron, the crossing is a corner too. None for what is no cell."""
    ids, g = np.asarray(ids, np.int64), grid()
    out: list[np.ndarray | None] = [None] * len(ids)
    for res, which in _by_resolution(ids):
        turn = np.exp(1j * TURN * (res % 2))
        spokes = np.exp(1j * np.pi / 3 * (np.arange(6) + 0.5)) * turn / 3**0.5 / 7 ** (res / 2)
        digits = digits_of(ids[which], res)
        alone = g.pentagon[(ids[which] >> 45) & 127] & (digits.sum(1) == 0)
        face, z = _centres_of(ids[which], res)
        corner = z[:, None] + spokes
        far = _outside(corner)
        crossing = (far.max(2) > EPS) != (np.roll(far, -1, 1).max(2) > EPS)
        lon, lat = _degrees(g.on_sphere(*_settle(np.repeat(face, 6), corner.ravel())))
        rings = np.stack([lon, lat], 1).reshape(-1, 6, 2)
        for k, at in enumerate(which.tolist()):
            if alone[k]:
                ring = _pentagon_ring(int(ids[at] >> 45) & 127, abs(spokes[0]), res)
            elif res % 2 and crossing[k].any():
                ring = _crossed_ring(int(face[k]), corner[k], far[k], rings[k])
            else:
                ring = rings[k]
            out[at] = np.concatenate([ring, ring[:1]])
    return out


def _crossed_ring(face: int, corner: np.ndarray, far: np.ndarray, ring: np.ndarray) -> np.ndarray:
    points = []
    for k in range(6):
        points.append(ring[k])
        a, b = far[k], far[(k + 1) % 6]
        for m in range(3):
            if min(a[m], b[m]) < -EPS and max(a[m], b[m]) > EPS:
                z = corner[k] + (corner[(k + 1) % 6] - corner[k]) * a[m] / (a[m] - b[m])
                if _outside(z).max() < EPS:
                    points.append(np.stack(_degrees(grid().on_sphere(np.array(face), np.array(z)))))
    return np.array(points)


def _pentagon_ring(base: int, radius: float, res: int) -> np.ndarray:
    """Five corners, and on odd resolutions the five crossings between them."""
    if res % 2:
        first = 30 + np.degrees(TURN) - 60
        corner = [(a, radius) for a in first + 60 * np.arange(5)]
        # A side is radius * cos 30 from the middle, at right angles to the direction between its corners.
        crossed = [(30.0 + 60 * k, radius * np.cos(np.pi / 6) / np.cos(np.radians(first))) for k in range(5)]
        points = sorted(corner + crossed)
    else:
        points = [(30.0 + 60 * k, radius) for k in range(-1, 4)]
    angle = np.array([a for a, _ in points])
    z = 2 + np.array([r for _, r in points]) * np.exp(1j * np.radians(angle))
    face, place = _about_pentagon(np.full(len(z), base), z, angle)
    return np.stack(_degrees(grid().on_sphere(face, place)), 1)


def children(ids: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of resolution res within cells of one coarser resolution, and which of ids each is in."""
    ids = np.asarray(ids, np.int64)
    parent = np.arange(len(ids))
    if not len(ids):
        return ids, parent
    g = grid()
    for level in range(int(resolution(ids)[0]) + 1, res + 1):
        shift = 3 * (MAX_RES - level)
        base = (ids & ~(15 << 52) & ~(7 << shift)) | (level << 52)
        made = base[:, None] | (np.arange(7) << shift)
        keep = np.ones(made.shape, bool)
        keep[:, K_AXIS] = ~(g.pentagon[(ids >> 45) & 127] & (_leading(digits_of(ids, level - 1)) == 0))
        parent = np.repeat(parent, keep.sum(1))
        ids = made[keep]
    return ids, parent


def base_cells() -> np.ndarray:
    return pack(np.arange(122), np.zeros((122, 0), np.int64), 0)


def h3_cell(lon: Column, lat: Column, res: int) -> Column:
    """The H3 id of a place, as a long."""

    @F.pandas_udf("long")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        found = cells(x.to_numpy(float, na_value=np.nan), y.to_numpy(float, na_value=np.nan), res)
        return pd.Series(found, dtype="Int64").mask(found == 0)

    return of(lon.cast("double"), lat.cast("double"))


def h3_centre(cell: Column) -> tuple[Column, Column]:
    """lon and lat of the middle of an H3 cell; null for what is no cell."""

    @F.pandas_udf("lon double, lat double")
    def of(ids: pd.Series) -> pd.DataFrame:
        lon, lat = centres(ids.fillna(0).to_numpy(np.int64))
        none = np.isnan(lon)
        return pd.DataFrame({"lon": pd.arrays.FloatingArray(lon, none), "lat": pd.arrays.FloatingArray(lat, none)})

    found = of(cell)
    return found["lon"], found["lat"]


def h3_boundary(cell: Column) -> Column:
    """Closed ring of (lon, lat) corners of an H3 cell; null for what is no cell."""

    @F.pandas_udf("array<array<double>>")
    def of(ids: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else r.tolist() for r in boundaries(ids.fillna(0).to_numpy(np.int64))], dtype=object)

    return of(cell)
