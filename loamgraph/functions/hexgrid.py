"""Positions to hexagonal cells and back, over arrays.

The public hexagonal grid lays a lattice of aperture seven on the faces of an
icosahedron. Here the faces' frames are the only geometry that is given: their
corners, neighbours, the lattice maps across edges, the 122 base cells and their
numbers are all derived from these. A position becomes lattice coordinates on its
face, which are carried up level by level to a base cell, leaving a digit each; a
cell is carried down again and unfolded over the edges its path crosses.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed values of the public grid: latitude, longitude of each face's centre and azimuth of its first axis, in radians.
FACES = np.array([
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882), (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055), (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400), (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874), (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154), (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562), (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361), (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535), (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316), (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436), (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
])
#: The two faces of a corner cell on which a path into its missing sector turns back clockwise.
CLOCKWISE = {14: (2, 6), 24: (1, 5), 38: (3, 7), 49: (0, 9), 58: (4, 8), 63: (11, 15), 72: (12, 16), 83: (10, 19), 97: (13, 17), 107: (14, 18)}
#: Length of a lattice step at level 0 on the plane that touches a face, and the turn between levels.
UNIT, TURN = 0.38196601125010500003, float(np.arcsin(np.sqrt(3 / 28)))

# Lattice coordinates are (i, j), with j a third of a turn from i. Digits 1 to 6 are the steps k, j, j + k, i, i + k, i + j.
STEPS = np.array([(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)])
ROUND = (4, 6, 2, 3, 1, 5)  # the digits counter-clockwise
_CCW = np.array([0] + [ROUND[(ROUND.index(d) + 1) % 6] for d in range(1, 7)])
_CW = np.argsort(_CCW)
#: The sectors around a corner, counter-clockwise from its home face; the sector of digit 1 is missing.
_SECTORS = (3, 5, 4, 6, 2)
_CORNERS = np.array([(2, 0), (0, 2), (-2, -2)])


def _digit_of(step: np.ndarray) -> np.ndarray:
    table = np.full((3, 3), -1)
    table[STEPS[:, 0] + 1, STEPS[:, 1] + 1] = np.arange(7)
    return table[step[:, 0] + 1, step[:, 1] + 1]


def _turned(ij: np.ndarray, times) -> np.ndarray:
    """Lattice vectors turned by so many sixths, counter-clockwise."""
    ij = np.array(ij)
    times = np.broadcast_to(np.asarray(times) % 6, ij.shape[:-1])
    for k in range(5):
        on = times > k
        ij[on] = np.stack([ij[on, 0] - ij[on, 1], ij[on, 0]], axis=-1)
    return ij


def _plane(ij: np.ndarray) -> np.ndarray:
    return np.stack([ij[..., 0] - ij[..., 1] / 2, ij[..., 1] * np.sqrt(3) / 2], axis=-1)


def _frames() -> np.ndarray:
    """Per face its centre and the directions of its axes, as unit vectors."""
    lat, lng, azimuth = FACES.T
    centre = np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)
    north = np.stack([-np.sin(lat) * np.cos(lng), -np.sin(lat) * np.sin(lng), np.cos(lat)], axis=1)
    east = np.stack([-np.sin(lng), np.cos(lng), np.zeros(20)], axis=1)
    toward = lambda a: np.cos(a)[:, None] * north + np.sin(a)[:, None] * east
    return np.stack([centre, toward(azimuth), toward(azimuth - np.pi / 2)], axis=1)


class Grid:
    """What follows from the faces' frames."""

    def __init__(self):
        self.frames = _frames()
        corner = np.array([[self.sphere(np.array([f]), _plane(c[None].astype(float)))[0] for c in _CORNERS] for f in range(20)])
        _, names = np.unique(np.round(corner.reshape(-1, 3), 6), axis=0, return_inverse=True)
        self.corner = names.reshape(20, 3)
        # Across edge e, between corners e and e + 1: the next face, and the turn and move of its lattice.
        self.next, self.turn, self.move = np.zeros((20, 3), int), np.zeros((20, 3), int), np.zeros((20, 3, 2), int)
        for f in range(20):
            for e in range(3):
                a, b = self.corner[f, e], self.corner[f, (e + 1) % 3]
                g = next(g for g in range(20) if g != f and a in self.corner[g] and b in self.corner[g])
                ga, gb = (_CORNERS[list(self.corner[g]).index(v)] for v in (a, b))
                span, want = _CORNERS[(e + 1) % 3] - _CORNERS[e], gb - ga
                turn = next(t for t in range(6) if (_turned(span[None], t)[0] == want).all())
                self.next[f, e], self.turn[f, e], self.move[f, e] = g, turn, ga - _turned(_CORNERS[e][None], turn)[0]
        self._number()

    def sphere(self, face: np.ndarray, xy: np.ndarray) -> np.ndarray:
        """Unit vectors of places on the planes of faces, in steps of level 0."""
        f = self.frames[face]
        p = f[:, 0] + UNIT * (xy[:, :1] * f[:, 1] + xy[:, 1:] * f[:, 2])
        return p / np.linalg.norm(p, axis=1, keepdims=True)

    def _homes(self):
        """(face, i, j) of every base cell: inside a face, on an edge, at a corner."""
        inside = [(0, 0), (1, 0), (0, 1), (-1, -1)]
        ij, jk, ik = (1, 1), (-1, 0), (0, -1)
        for f in range(20):
            edges = [[ij, jk], [ik], [ij], [jk, ik]][f // 5]
            corner = [(2, 0)] if f in (0, 19) or 5 <= f < 15 else []
            yield from ((f, *c) for c in (*inside, *edges, *corner))

    def _number(self):
        homes = np.array(list(self._homes()))
        z = self.sphere(homes[:, 0], _plane(homes[:, 1:].astype(float)))[:, 2]
        homes = homes[np.argsort(-z, kind="stable")]  # base cells count from north to south
        self.home_face, self.home = homes[:, 0], homes[:, 1:]
        self.is_corner = (self.home == (2, 0)).all(axis=1)
        name = {tuple(h): b for b, h in enumerate(homes.tolist())}
        at_corner = {self.corner[f, 0]: b for b, f in enumerate(self.home_face) if self.is_corner[b]}
        # Faces around each corner, counter-clockwise from the home face.
        self.around = {}
        for v, b in at_corner.items():
            ring, f = [], int(self.home_face[b])
            for _ in range(5):
                ring.append(f)
                f = int(self.next[f, (list(self.corner[f]).index(v) + 2) % 3])
            self.around[b] = ring
        # Base cell and turns of each place of level 0 on each face; -1 where no face has it.
        self.base, self.turns = np.full((20, 5, 5), -1), np.zeros((20, 5, 5), int)
        for f in range(20):
            for i in range(-2, 3):
                for j in range(-2, 3):
                    found = self._base_of(f, np.array([i, j]), name, at_corner)
                    if found:
                        self.base[f, i + 2, j + 2], self.turns[f, i + 2, j + 2] = found

    def _base_of(self, f: int, ij: np.ndarray, name: dict, at_corner: dict):
        for c in range(3):
            if (ij == _CORNERS[c]).all():
                b = at_corner[self.corner[f, c]]
                own = _SECTORS.index((3, 5, 6)[c])  # the digit that points from the corner into the face
                return b, (self.around[b].index(f) - own) % 5
        places = [(f, ij, 0)]
        for e in range(3):
            places.append((int(self.next[f, e]), _turned(ij[None], self.turn[f, e])[0] + self.move[f, e], int(self.turn[f, e])))
        return next(((name[k], t) for g, p, t in places if (k := (g, *p.tolist())) in name), None)


@lru_cache(maxsize=1)
def grid() -> Grid:
    return Grid()


def _nearest(xy: np.ndarray) -> np.ndarray:
    """The lattice place nearest to each point of the plane."""
    j = xy[:, 1] * 2 / np.sqrt(3)
    cube = np.stack([xy[:, 0] + j / 2 - j, j, -(xy[:, 0] + j / 2)], axis=1)  # i - j, j, -i
    whole = np.round(cube)
    off = np.abs(whole - cube)
    worst = off.argmax(axis=1)
    rows = np.arange(len(xy))
    whole[rows, worst] -= whole.sum(axis=1)
    return np.stack([-whole[:, 2], whole[:, 1]], axis=1).astype(np.int64)


def _up(ij: np.ndarray, odd: bool) -> np.ndarray:
    i, j = ij[:, 0], ij[:, 1]
    pair = (3 * i - j, i + 2 * j) if odd else (2 * i + j, 3 * j - i)
    return np.stack([(p * 2 + 7) // 14 for p in pair], axis=1)


def _down(ij: np.ndarray, odd: bool) -> np.ndarray:
    i, j = ij[:, 0], ij[:, 1]
    return np.stack([2 * i + j, 3 * j - i] if odd else [3 * i - j, i + 2 * j], axis=1)


def cells_of(lat: np.ndarray, lng: np.ndarray, resolution: int) -> np.ndarray:
    """The cell ids, as integers, of positions in degrees; 0 where a position is no number."""
    lat, lng = np.asarray(lat, float), np.asarray(lng, float)
    ok = np.isfinite(lat) & np.isfinite(lng)
    out = np.zeros(len(lat), np.int64)
    la, lo = np.radians(lat[ok]), np.radians(lng[ok])
    p = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
    out[ok] = _cells(p, resolution)
    return out


def _cells(p: np.ndarray, resolution: int) -> np.ndarray:
    g, n = grid(), len(p)
    if not n:
        return np.zeros(0, np.int64)
    face = (p @ g.frames[:, 0].T).argmax(axis=1)
    f = g.frames[face]
    dots = np.einsum("nij,nj->ni", f, p)
    xy = dots[:, 1:] / dots[:, :1] / UNIT * np.sqrt(7.0) ** resolution
    ij = _nearest(_rotated(xy, -TURN) if resolution % 2 else xy)
    digits = np.zeros((resolution + 1, n), np.int64)
    for r in range(resolution, 0, -1):
        above = _up(ij, r % 2 == 1)
        digits[r] = _digit_of(ij - _down(above, r % 2 == 1))
        ij = above
    i, j = np.clip(ij[:, 0] + 2, 0, 4), np.clip(ij[:, 1] + 2, 0, 4)
    base, turns = g.base[face, i, j], g.turns[face, i, j]
    corner = g.is_corner[base]
    inverse = np.zeros((n, 2), bool)
    for b, faces in CLOCKWISE.items():
        inverse[base == b] = np.isin(face[base == b], faces)[:, None]
    stuck = corner & (_leading(digits) == 1)
    digits = np.where(stuck, np.where(inverse[:, 0], _CW[digits], _CCW[digits]), digits)
    for k in range(1, 6):
        on = turns >= k
        digits = np.where(on, _CCW[digits], digits)
        digits = np.where(on & corner & (_leading(digits) == 1), _CCW[digits], digits)
    out = np.full(n, (1 << 59) | (resolution << 52), np.int64) | (base << 45)
    for r in range(1, 16):
        out |= (digits[r] if r <= resolution else np.int64(7)) << (3 * (15 - r))
    return np.where(base >= 0, out, 0)


def _rotated(xy: np.ndarray, angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.stack([c * xy[:, 0] - s * xy[:, 1], s * xy[:, 0] + c * xy[:, 1]], axis=1)


def _leading(digits: np.ndarray) -> np.ndarray:
    """The first digit that is not 0 in each column; 0 if there is none."""
    there = digits != 0
    return np.where(there.any(axis=0), digits[there.argmax(axis=0), np.arange(digits.shape[1])], 0)


def valid(cells: np.ndarray) -> np.ndarray:
    """Whether each integer is a cell id: its fixed bits, base cell, digits and, at corners, the missing sector."""
    cells = np.asarray(cells, np.int64)
    resolution, base = (cells >> 52) & 15, (cells >> 45) & 127
    ok = ((cells >> 56) == 8) & (base < 122)
    digits = (cells[None, :] >> (3 * (15 - np.arange(16)[:, None]))) & 7
    digits[0] = 0
    used = np.arange(16)[:, None] <= resolution
    ok &= np.where(used, digits < 7, digits == 7).all(axis=0)
    lead = _leading(np.where(used, digits, 0))
    return ok & ~(grid().is_corner[np.minimum(base, 121)] & (lead == 1))


def _placed(cells: np.ndarray):
    """(face, x, y in steps of level 0) of valid cells, on or next to the face they lie on."""
    g = grid()
    resolution, base = (cells >> 52) & 15, (cells >> 45) & 127
    digits = (cells[None, :] >> (3 * (15 - np.arange(16)[:, None]))) & 7
    digits = np.where((np.arange(16)[:, None] >= 1) & (np.arange(16)[:, None] <= resolution), digits, 0)
    face, home = g.home_face[base].copy(), g.home[base].astype(float)
    at = np.zeros((len(cells), 2), np.int64)
    for r in range(1, 16):
        on = r <= resolution
        at = np.where(on[:, None], _down(at, r % 2 == 1) + STEPS[digits[r]], at)
    v = _plane(at.astype(float)) / np.sqrt(7.0)[None] ** resolution[:, None]
    v = np.where((resolution % 2 == 1)[:, None], _rotated(v, TURN), v)
    xy = v + _plane(home)
    # Around a corner the digit tells the face: its sector turned into that face's own.
    lead = _leading(digits)
    for k in np.flatnonzero(g.is_corner[base] & (lead > 0)):
        b, n = int(base[k]), _SECTORS.index(int(lead[k]))
        f = g.around[b][n]
        c = list(g.corner[f]).index(g.corner[g.home_face[b], 0])
        turn = ROUND.index((3, 5, 6)[c]) - ROUND.index(int(lead[k]))
        face[k], xy[k] = f, _rotated(v[k : k + 1], turn * np.pi / 3)[0] + _plane(_CORNERS[c][None].astype(float))[0]
    return face, xy


#: Outward directions of a face's edges on its plane; each edge lies one step from the centre.
_NORMALS = np.array([[np.cos(a), np.sin(a)] for a in np.radians([60.0, 180.0, 300.0])])


def _unfolded(face: np.ndarray, xy: np.ndarray):
    """Places beyond the edges of their face brought to the faces they lie on."""
    g = grid()
    for _ in range(4):
        beyond = xy @ _NORMALS.T - 1.0
        e = beyond.argmax(axis=1)
        out = np.flatnonzero(beyond[np.arange(len(e)), e] > 1e-9)
        if not len(out):
            break
        f, e = face[out], e[out]
        turn = g.turn[f, e] * np.pi / 3
        c, s = np.cos(turn), np.sin(turn)
        x, y = xy[out].T
        xy[out] = np.stack([c * x - s * y, s * x + c * y], axis=1) + _plane(g.move[f, e].astype(float))
        face[out] = g.next[f, e]
    return face, xy


def centres_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(latitude, longitude) in degrees of the centres of cell ids; NaN for what is no cell."""
    cells = np.asarray(cells, np.int64)
    ok = valid(cells) if len(cells) else np.zeros(0, bool)
    lat, lng = np.full(len(cells), np.nan), np.full(len(cells), np.nan)
    if ok.any():
        p = grid().sphere(*_unfolded(*_placed(cells[ok])))
        lat[ok], lng[ok] = np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1))), np.degrees(np.arctan2(p[:, 1], p[:, 0]))
    return lat, lng


def disk(cells: np.ndarray, k: int = 1) -> np.ndarray:
    """The distinct cells within ``k`` steps of valid cells of one resolution, the cells themselves included.

    Around the twelve corner cells, where a sector is missing, steps may meet.
    """
    cells = np.unique(np.asarray(cells, np.int64))
    if not len(cells):
        return cells
    resolution = int((cells[0] >> 52) & 15)
    steps = np.array([(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if abs(i - j) <= k])
    size = np.sqrt(7.0) ** -resolution
    moves = _rotated(_plane(steps.astype(float)) * size, TURN if resolution % 2 else 0.0)
    face, xy = _unfolded(*_placed(cells))
    face, xy = np.repeat(face, len(moves)), (xy[:, None, :] + moves[None]).reshape(-1, 2)
    return np.unique(np.concatenate([cells, _cells(grid().sphere(*_unfolded(face, xy)), resolution)]))


def cover(south: float, west: float, north: float, east: float, resolution: int) -> np.ndarray:
    """The distinct cells with their centre in a box of degrees, with those of its corners and its middle.

    The box is sampled more finely than cells lie apart, so use it with a
    resolution that fits the box, as a map's zoom does.
    """
    step = np.degrees(UNIT * np.sqrt(7.0) ** -resolution) * 0.3
    lats = np.linspace(south, north, max(2, int(np.ceil((north - south) / step)) + 1))
    rows = []
    for la in lats:
        wide = max(2, int(np.ceil((east - west) * max(np.cos(np.radians(la)), 1e-6) / step)) + 1)
        rows.append(np.unique(cells_of(np.full(wide, la), np.linspace(west, east, wide), resolution)))
    found = np.unique(np.concatenate(rows))
    la, lo = centres_of(found)
    inside = found[(la >= south) & (la <= north) & (lo >= west) & (lo <= east)]
    points = np.array([(south, west), (south, east), (north, east), (north, west), ((south + north) / 2, (west + east) / 2)])
    return np.unique(np.concatenate([inside, cells_of(points[:, 0], points[:, 1], resolution)]))


def texts(cells: np.ndarray) -> list[str | None]:
    return [f"{c:x}" if c else None for c in np.asarray(cells, np.int64).tolist()]


def numbers(cells) -> np.ndarray:
    """Integers of written ids; 0 for what is none."""
    out = np.zeros(len(cells), np.int64)
    for k, c in enumerate(cells):
        try:
            n = int(c, 16) if isinstance(c, str) else 0
        except ValueError:
            n = 0
        out[k] = n if 0 < n < 1 << 63 else 0
    return out
