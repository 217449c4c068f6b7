"""Hulls, areas, simplification and union of polygons in longitude and latitude."""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict

import numpy as np

from loamgraph.functions.geometry import EARTH_RADIUS_M, polygons_of
from loamgraph.functions.tracks import _hull

#: Fixed values of the shape API.
DEFAULT_ALPHA = 0.5
MIN_HOLE_AREA_M2 = 100_000.0
DEFAULT_TOLERANCE_DEG = 0.01
ROLE_KEY = "bold:depictionRole"
DEFAULT_ROLE = "detail"


def positions_of(node) -> list[tuple[float, float]]:
    """All [lng, lat] positions of a GeoJSON value of any kind."""
    if isinstance(node, dict):
        parts = node.get("features") or node.get("geometries") or [node.get("geometry")] if node.get("type") in ("FeatureCollection", "GeometryCollection", "Feature") else [node.get("coordinates")]
        return [p for x in parts for p in positions_of(x)]
    if isinstance(node, (list, tuple)) and node:
        if isinstance(node[0], (int, float)) and not isinstance(node[0], bool):
            ok = len(node) > 1 and all(isinstance(v, (int, float)) and math.isfinite(v) for v in node[:2])
            return [(float(node[0]), float(node[1]))] if ok else []
        return [p for x in node for p in positions_of(x)]
    return []


def ring_area(ring) -> float:
    """Signed spherical area in square metres: each corner's latitude against the span of its neighbours' longitudes."""
    r = np.asarray(ring, float).reshape(-1, 2)
    if len(r) < 3:
        return 0.0
    lng, lat = np.radians(r[:, 0]), np.radians(r[:, 1])
    return float(((np.roll(lng, -2) - lng) * np.sin(np.roll(lat, -1))).sum() * EARTH_RADIUS_M**2 / 2)


def polygon_area(rings) -> float:
    """The outer ring's area less its holes'."""
    a = [abs(ring_area(r)) for r in rings]
    return abs(a[0] - sum(a[1:])) if a else 0.0


def geo_area(text: str | None) -> float:
    """Area of a depiction; each polygon counts, other kinds have none."""
    return sum(polygon_area([np.vstack([r, r[:1]]) for r in p]) for p in polygons_of(text))


def signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (indices) by incremental insertion, each point opening the circles it lies in."""
    n = len(p)
    centre, span = p.mean(axis=0), max(float(np.ptp(p, axis=0).max()), 1e-12)
    corners = centre + span * 50 * np.array([[0, 2.0], [-2.0, -1.5], [2.0, -1.5]])
    q = np.vstack([p, corners])
    tri, circles = [(n, n + 1, n + 2)], [_circumcircle(q[[n, n + 1, n + 2]])]
    for i in np.argsort(p[:, 0], kind="stable"):
        c = np.array(circles)
        hit = np.flatnonzero(((c[:, :2] - q[i]) ** 2).sum(axis=1) < c[:, 2] * (1 + 1e-12))
        edges = Counter(tuple(sorted(e)) for t in hit for e in zip(tri[t], (*tri[t][1:], tri[t][0])))
        gone = set(hit.tolist())
        tri, circles = [t for k, t in enumerate(tri) if k not in gone], [x for k, x in enumerate(circles) if k not in gone]
        for (a, b), times in edges.items():
            if times == 1:
                circle = _circumcircle(q[[a, b, i]])
                if circle is not None:
                    tri.append((a, b, int(i)))
                    circles.append(circle)
    return np.array([t for t in tri if max(t) < n], int).reshape(-1, 3)


def _circumcircle(t: np.ndarray):
    (ax, ay), (bx, by), (cx, cy) = t
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(d) < 1e-18:
        return None
    sq = (t**2).sum(axis=1)
    ux = (sq[0] * (by - cy) + sq[1] * (cy - ay) + sq[2] * (ay - by)) / d
    uy = (sq[0] * (cx - bx) + sq[1] * (ax - cx) + sq[2] * (bx - ax)) / d
    return np.array([ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2])


def chain_rings(edges: list[tuple]) -> list[list]:
    """Closed rings from undirected edges between hashable ends; open chains are left out."""
    links = defaultdict(list)
    for a, b in edges:
        links[a].append(b)
        links[b].append(a)
    rings = []
    while links:
        start = next(iter(links))
        ring = [start]
        while True:
            here = ring[-1]
            if not links.get(here):
                links.pop(here, None)
                ring = []
                break
            nxt = links[here].pop()
            links[nxt].remove(here)
            for k in (here, nxt):
                if not links[k]:
                    del links[k]
            if nxt == start:
                break
            ring.append(nxt)
        if len(ring) >= 3:
            rings.append(ring)
    return rings


def concave_hull(p: np.ndarray, alpha: float = DEFAULT_ALPHA) -> np.ndarray:
    """The largest ring around the triangles whose longest edge is at most max - alpha (max - median); else the convex hull."""
    if len(p) < 4:
        return _hull(p)
    tri = delaunay(p)
    if not len(tri):
        return _hull(p)
    lengths = np.stack([np.hypot(*(p[tri[:, i]] - p[tri[:, (i + 1) % 3]]).T) for i in range(3)], axis=1)
    ordered = np.sort(lengths.ravel())
    limit = ordered[-1] - alpha * (ordered[-1] - ordered[len(ordered) // 2])
    count = Counter(tuple(sorted(e)) for t in tri[lengths.max(axis=1) <= limit].tolist() for e in zip(t, (*t[1:], t[0])))
    rings = chain_rings([e for e, n in count.items() if n == 1])
    return p[max(rings, key=lambda r: abs(signed_area(p[r])))] if rings else _hull(p)


def spatial_range(points: np.ndarray, hull: str = "convex", alpha: float = DEFAULT_ALPHA, winding: str = "cw") -> dict | None:
    """A closed hull ring of [lng, lat] points with centroid (of all points), count and area; None for fewer than three places."""
    if hull not in ("convex", "concave") or winding not in ("cw", "ccw"):
        raise ValueError(f"unknown hull {hull!r} or winding {winding!r}")
    places = np.unique(points, axis=0) if len(points) else points
    if len(places) < 3:
        return None
    scale = math.cos(math.radians(float(places[:, 1].mean()))) or 1.0
    plane = places * [scale, 1.0]
    ring = _hull(plane) if hull == "convex" else concave_hull(plane, alpha)
    if len(ring) < 3 or signed_area(ring) == 0:
        return None
    if (signed_area(ring) < 0) != (winding == "cw"):
        ring = ring[::-1]
    ring = np.vstack([ring, ring[:1]]) / [scale, 1.0]
    return {"ring": ring, "centroid": points.mean(axis=0), "count": len(points), "distinct": len(places), "area_km2": round(abs(ring_area(ring)) / 1e6, 2)}


def simplify_path(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas-Peucker keeps, by distance to the segment; all of them for no tolerance."""
    n = len(p)
    if n <= 2 or not tolerance > 0:
        return np.arange(n)
    keep, todo = {0, n - 1}, [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, v = p[b] - p[a], p[a + 1 : b] - p[a]
        length = float(d @ d)
        share = np.clip(v @ d / length, 0, 1) if length else np.zeros(len(v))
        off = np.hypot(*(v - share[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep))


def simplify_rings(polygons: list[list[np.ndarray]], tolerance: float = DEFAULT_TOLERANCE_DEG) -> list[list[np.ndarray]]:
    """Open rings simplified between their first place and the one farthest from it; rings under three corners go, and a polygon with its outer ring."""
    every = [r for p in polygons for r in p]
    if not every:
        return []
    scale = math.cos(math.radians(float(np.concatenate(every)[:, 1].mean()))) or 1.0
    out = []
    for rings in polygons:
        kept = []
        for k, r in enumerate(rings):
            plane = r * [scale, 1.0]
            far = int(np.hypot(*(plane - plane[0]).T).argmax())
            head, tail = simplify_path(plane[: far + 1], tolerance), far + simplify_path(np.vstack([plane[far:], plane[:1]]), tolerance)
            at = np.concatenate([head, tail[1:-1]]).astype(int)
            if far and len(at) >= 3:
                kept.append(r[at])
            elif k == 0:
                break
        if kept:
            out.append(kept)
    return out


def inside_any(x: np.ndarray, y: np.ndarray, polygons: list[list[np.ndarray]]) -> np.ndarray:
    """Whether points lie in any of the polygons (even-odd within each)."""
    out = np.zeros(len(x), bool)
    for rings in polygons:
        e = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings])
        e = e[e[:, 1] != e[:, 3]]
        spans = (e[:, 1] > y[:, None]) != (e[:, 3] > y[:, None])
        at = e[:, 0] + (e[:, 2] - e[:, 0]) * (y[:, None] - e[:, 1]) / (e[:, 3] - e[:, 1])
        out |= (spans & (x[:, None] < at)).sum(axis=1) % 2 == 1
    return out


def union_polygons(polygons: list[list[np.ndarray]], min_hole_m2: float = MIN_HOLE_AREA_M2) -> list[list[np.ndarray]]:
    """The union as polygons with holes, outer rings counterclockwise.

    Every edge is cut where it meets another; the pieces with the inside on just
    one hand make the border, and they are chained into rings.
    """
    if not polygons:
        return []
    e = np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for p in polygons for r in p])
    e = e[(e[:, :2] != e[:, 2:]).any(axis=1)]
    pieces = set()
    size = max(float(np.ptp(e.reshape(-1, 2), axis=0).max()), 1e-9)
    places: dict[tuple, tuple] = {}  # corners stand for what is rounded to them

    def snap(p):
        return places.setdefault((round(p[0] / size, 11), round(p[1] / size, 11)), (float(p[0]), float(p[1])))

    for corner in e[:, :2]:
        snap(corner)
    for a in e:
        p, d = a[:2], a[2:] - a[:2]
        q, f = e[:, :2], e[:, 2:] - e[:, :2]
        cross = d[0] * f[:, 1] - d[1] * f[:, 0]
        w = q - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * f[:, 1] - w[:, 1] * f[:, 0]) / cross
            u = (w[:, 0] * d[1] - w[:, 1] * d[0]) / cross
        ts = t[(np.abs(cross) > 0) & (t > 0) & (t < 1) & (u >= -1e-12) & (u <= 1 + 1e-12)]
        # Ends of edges that lie on this one.
        ends = e.reshape(-1, 2) - p
        along = ends @ d / (d @ d)
        off = np.abs(ends[:, 0] * d[1] - ends[:, 1] * d[0]) / math.sqrt(d @ d)
        ts = np.unique(np.concatenate([[0, 1], ts, along[(off < 1e-12 * size) & (along > 0) & (along < 1)]]))
        nodes = [snap(p + v * d) for v in ts]
        pieces |= {(min(x, y), max(x, y)) for x, y in zip(nodes, nodes[1:]) if x != y}
    seg = np.array([[*x, *y] for x, y in pieces])
    mid, d = (seg[:, :2] + seg[:, 2:]) / 2, seg[:, 2:] - seg[:, :2]
    normal = np.column_stack([-d[:, 1], d[:, 0]]) / np.hypot(*d.T)[:, None] * size * 1e-7
    left, right = inside_any(*(mid + normal).T, polygons), inside_any(*(mid - normal).T, polygons)
    # Every border piece runs with the inside on its left.
    border = np.vstack([seg[left & ~right], seg[right & ~left][:, [2, 3, 0, 1]]])
    rings = [np.array(r) for r in _walk(border)]
    out = [[r] for r in rings if signed_area(r) > 0]
    holes = [r for r in rings if signed_area(r) < 0]
    for h in holes:
        if abs(ring_area(h)) < min_hole_m2:
            continue
        x, y = _inner_point(h)
        owners = [p for p in out if inside_any(np.array([x]), np.array([y]), [[p[0]]])[0]]
        if owners:
            min(owners, key=lambda p: abs(signed_area(p[0]))).append(h)
    return out


def _walk(edges: np.ndarray) -> list[list]:
    """Rings of directed edges; where several leave a place, the sharpest turn to the left keeps shapes that touch apart."""
    leaving = defaultdict(list)
    for e in edges.tolist():
        leaving[tuple(e[:2])].append(tuple(e[2:]))
    rings = []
    while leaving:
        start = next(iter(leaving))
        ring, here, came = [start], start, None
        while leaving.get(here):
            options = leaving[here]
            if came is None or len(options) == 1:
                nxt = options.pop()
            else:
                d = (here[0] - came[0], here[1] - came[1])
                turn = lambda q: math.atan2(d[0] * (q[1] - here[1]) - d[1] * (q[0] - here[0]), d[0] * (q[0] - here[0]) + d[1] * (q[1] - here[1]))  # noqa: B023, E731
                nxt = max(options, key=turn)
                options.remove(nxt)
            if not options:
                del leaving[here]
            if nxt in ring:
                # A loop closes; what led to it goes on.
                k = ring.index(nxt)
                if len(ring) - k >= 3:
                    rings.append(ring[k:])
                ring = ring[: k + 1]
                came = ring[-2] if len(ring) > 1 else None
                here = nxt
                if len(ring) == 1:
                    break
                continue
            ring.append(nxt)
            came, here = here, nxt
        leaving = defaultdict(list, {k: v for k, v in leaving.items() if v})
    return rings


def _inner_point(r: np.ndarray) -> np.ndarray:
    """A place just inside a ring, beside the middle of its longest edge."""
    d = np.roll(r, -1, axis=0) - r
    k = int(np.hypot(*d.T).argmax())
    n = np.array([-d[k, 1], d[k, 0]]) * 1e-7
    p = r[k] + d[k] / 2 + n
    return p if inside_any(p[:1], p[1:], [[r]])[0] else r[k] + d[k] / 2 - n


def to_geojson(polygons: list[list[np.ndarray]], winding: str = "ccw") -> dict | None:
    if not polygons:
        return None
    turn = lambda r, k: r if (signed_area(r) > 0) == ((winding == "ccw") == (k == 0)) else r[::-1]
    coords = [[np.vstack([t := turn(r, k), t[:1]]).tolist() for k, r in enumerate(p)] for p in polygons]
    return {"type": "Polygon", "coordinates": coords[0]} if len(coords) == 1 else {"type": "MultiPolygon", "coordinates": coords}


def pick_depiction(depictions, role: str, strict: bool = False):
    """The depiction of a role; an untagged one has the default role; else, unless strict, the first."""
    found = [d for d in (depictions if isinstance(depictions, list) else [depictions]) if isinstance(d, dict)]
    role_of = lambda d: (d.get("properties") or {}).get(ROLE_KEY)
    for wanted in [role, *([None] if role == DEFAULT_ROLE else [])]:
        for d in found:
            if role_of(d) == wanted:
                return d
    return None if strict or not found else found[0]


def with_role(feature: dict, role: str) -> dict:
    return {**feature, "properties": {**(feature.get("properties") or {}), ROLE_KEY: role}}


def depiction_text(value) -> str:
    return json.dumps(value, separators=(",", ":"))
