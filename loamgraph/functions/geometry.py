"""Numpy geometry shared by the spatial operators: depictions, rings and slabs."""

from __future__ import annotations

import json

import numpy as np

EARTH_RADIUS_M = 6_371_008.8


def polygons_of(text: str | None) -> list[list[np.ndarray]]:
    """The polygons (rings of [lng, lat]) of a GeoJSON text.

    Reads Polygon, MultiPolygon, Feature, FeatureCollection, GeometryCollection
    and arrays of these. Text that is null, empty, not JSON or of another kind has
    none; rings with fewer than three distinct positions are left out.
    """
    if not text:
        return []
    try:
        return [p for p in map(_rings, _polygons(json.loads(text))) if p]
    except (ValueError, RecursionError):
        return []


def _polygons(node):
    if isinstance(node, list):
        for x in node:
            yield from _polygons(x)
    elif isinstance(node, dict):
        kind, coords = node.get("type"), node.get("coordinates")
        if kind == "Feature":
            yield from _polygons(node.get("geometry"))
        elif kind in ("FeatureCollection", "GeometryCollection"):
            yield from _polygons(node.get("features") or node.get("geometries"))
        elif kind == "Polygon" and isinstance(coords, list):
            yield coords
        elif kind == "MultiPolygon" and isinstance(coords, list):
            yield from (c for c in coords if isinstance(c, list))


def _rings(coords) -> list[np.ndarray]:
    out = []
    for k, ring in enumerate(coords):
        points = [p[:2] for p in ring if isinstance(p, list) and len(p) >= 2 and all(isinstance(v, (int, float)) and np.isfinite(v) for v in p[:2])] if isinstance(ring, list) else []
        xy = np.array(points, dtype=float).reshape(-1, 2)
        if len(xy) > 1 and (xy[0] == xy[-1]).all():
            xy = xy[:-1]
        if len(np.unique(xy, axis=0)) >= 3:
            out.append(xy)
        elif k == 0:
            return []  # no outer ring, so holes cut nothing
    return out


def slabs_of(rings: list[np.ndarray]) -> list[tuple[float, float, np.ndarray]]:
    """Trapezoidal decomposition: (x0, x1, edges) with edges (ax, ay, bx, by) in order of y.

    Slab borders are the vertices' x and, where rings cross each other or
    themselves, the crossings, so that edges never change order inside a slab.
    """
    edges = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings])
    edges = edges[edges[:, 0] != edges[:, 2]]
    if not len(edges):
        return []
    flip = edges[:, 0] > edges[:, 2]
    edges[flip] = edges[flip][:, [2, 3, 0, 1]]
    xs = np.unique(edges[:, [0, 2]])
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    out = []
    for x0, x1 in zip(xs[:-1], xs[1:]):
        e = edges[: np.searchsorted(edges[:, 0], x0, side="right")]
        e = e[e[:, 2] >= x1]
        if not len(e):
            continue
        y0, y1 = edge_y(e, x0), edge_y(e, x1)
        order = np.lexsort((y1, y0))
        e, y0, y1 = e[order], y0[order], y1[order]
        cuts = np.array([x0, x1])
        if (np.diff(y1) < 0).any():
            i, j = np.nonzero(np.triu(y1[:, None] > y1[None, :], 1))
            d0, d1 = y0[j] - y0[i], y1[j] - y1[i]
            cuts = np.unique(np.concatenate([cuts, np.clip(x0 + (x1 - x0) * d0 / (d0 - d1), x0, x1)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            out.append((float(a), float(b), e[np.argsort(edge_y(e, (a + b) / 2), kind="stable")]))
    return out


def edge_y(e: np.ndarray, x) -> np.ndarray:
    return e[..., 1] + (e[..., 3] - e[..., 1]) * (x - e[..., 0]) / (e[..., 2] - e[..., 0])


#: Pairs of points and polygons that are held at a time (about 100 bytes each).
PAIRS = 1_000_000


class SlabIndex:
    """Slabs of many polygons as flat arrays; locates points by two binary searches, all points and polygons at once."""

    def __init__(self, polygon: np.ndarray, x0: np.ndarray, x1: np.ndarray, counts: np.ndarray, edges: np.ndarray):
        order = np.lexsort((x0, polygon))
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        counts = np.asarray(counts)[order]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        row = np.repeat(np.arange(len(order)), counts)
        self.edges = edges[starts[order][row] + np.arange(len(row)) - self.first[row]]
        polygon, self.x0, self.x1 = polygon[order], x0[order], x1[order]
        self.parts, self.begin = np.unique(polygon, return_index=True)
        self.end = np.append(self.begin[1:], len(polygon))
        if len(order):
            ys = self.edges[:, [1, 3]]
            low, high = np.minimum.reduceat(ys.min(axis=1), self.first[self.begin]), np.maximum.reduceat(ys.max(axis=1), self.first[self.begin])
            self.box = self.x0[self.begin], np.maximum.reduceat(self.x1, self.begin), low, high

    def _ranges(self, x: np.ndarray, y: np.ndarray):
        """(order of the points, polygon and range in that order) of points whose band and x may meet a polygon's box."""
        bx0, bx1, by0, by1 = self.box
        height = max(float((by1 - by0).mean()), 1e-9)
        base = min(float(y.min()), float(by0.min()))
        height = max(height, (max(float(y.max()), float(by1.max())) - base) / (1 << 28))
        west = min(float(x.min()), float(bx0.min()))
        unit = (max(float(x.max()), float(bx1.max())) - west) / (1 << 30) or 1.0
        band = lambda v: np.floor((v - base) / height).astype(np.int64)
        place = lambda v: np.floor((v - west) / unit).astype(np.int64)
        key = (band(y) << 32) | place(x)
        order = np.argsort(key, kind="stable")
        key = key[order]
        n = band(by1) - band(by0) + 1
        polygon = np.repeat(np.arange(len(n)), n)
        at = band(by0)[polygon] + np.arange(len(polygon)) - np.repeat(np.cumsum(n) - n, n)
        lo = np.searchsorted(key, (at << 32) | np.maximum(place(bx0)[polygon] - 1, 0))
        hi = np.searchsorted(key, (at << 32) | (place(bx1)[polygon] + 1), side="right")
        some = hi > lo
        return order, polygon[some], lo[some], hi[some]

    def locate(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, polygon) for every polygon that holds the point."""
        points, found = [np.zeros(0, np.int64)], [self.parts[:0]]
        if len(x) and len(self.parts):
            order, polygon, lo, hi = self._ranges(x, y)
            run = np.cumsum(hi - lo) // PAIRS
            for k in np.unique(run):
                rows = np.flatnonzero(run == k)
                n = hi[rows] - lo[rows]
                row = np.repeat(np.arange(len(rows)), n)
                i = order[lo[rows][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
                i, part = self._inside(x, y, i, polygon[rows][row])
                points.append(i)
                found.append(self.parts[part])
        return np.concatenate(points), np.concatenate(found)

    def _inside(self, x, y, i, part):
        """Of the pairs of point and polygon those of which the polygon holds the point."""
        bx0, bx1, by0, by1 = self.box
        near = (x[i] >= bx0[part]) & (x[i] < bx1[part]) & (y[i] >= by0[part]) & (y[i] <= by1[part])
        i, part = i[near], part[near]
        slab = search(self.x0, self.begin[part], self.end[part], x[i], True) - 1
        ok = (slab >= self.begin[part]) & (x[i] < self.x1[np.maximum(slab, 0)])
        i, part, slab = i[ok], part[ok], slab[ok]
        lo, hi = self.first[slab], self.first[slab + 1]
        start = lo
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi) // 2, 0)
            below = open_ & (edge_y(self.edges[mid], x[i]) < y[i])
            lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        inside = (lo - start) % 2 == 1
        return i[inside], part[inside]


def search(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """``np.searchsorted`` of each wanted number in its own range lo..hi of ``values``."""
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        below = open_ & ((values[mid] <= wanted) if right else (values[mid] < wanted))
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def great_circle_m(lat1, lng1, lat2, lng2) -> np.ndarray:
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def circle_slabs(lat: np.ndarray, lng: np.ndarray, radius_m: float):
    """Slabs of a polygon around the circle of each point: (point, x0, x1, edges, copy).

    The polygon is an octagon around the circle, a little wider than it, that
    stretches with the latitude; where the circle comes near a pole it is the whole
    band of latitudes. Polygons that cross meridian 180 have a copy beyond it.
    """
    turn = np.pi / 8 * (1 + 2 * np.arange(8))
    ring = np.column_stack([np.cos(turn), np.sin(turn)]) / np.cos(np.pi / 8)
    cap = np.array([[-1.0, -1.0], [1.0, -1.0], [1.0, 1.0], [-1.0, 1.0]])
    reach = np.degrees(radius_m / EARTH_RADIUS_M) * 1.01
    polar = np.abs(lat) + reach >= 89.9
    width = np.where(polar, 361.0, reach / np.maximum(np.cos(np.radians(np.minimum(np.abs(lat) + reach, 89.95))), 1e-9))
    out = []
    for shape, rows in ((ring, np.flatnonzero(~polar)), (cap, np.flatnonzero(polar))):
        shifts = (0.0,) if shape is cap else (0.0, 360.0, -360.0)
        for copy, shift in enumerate(shifts):
            r = rows if shift == 0 else rows[(lng[rows] + shift - width[rows] < 180) & (lng[rows] + shift + width[rows] > -180)]
            for x0, x1, e in slabs_of([shape]) if len(r) else ():
                move = np.column_stack([lng[r] + shift, lat[r], lng[r] + shift, lat[r]])
                size = np.column_stack([width[r], np.full(len(r), reach), width[r], np.full(len(r), reach)])
                edges = e[None, :, :] * size[:, None, :] + move[:, None, :]
                out.append((r, x0 * width[r] + lng[r] + shift, x1 * width[r] + lng[r] + shift, edges, np.full(len(r), copy)))
    return out
