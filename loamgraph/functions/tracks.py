"""Stops and trips in ordered pings: numpy over many tracks at once."""

from __future__ import annotations

import math

import numpy as np

from loamgraph.functions.geometry import EARTH_RADIUS_M


def on_sphere(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Positions in metres from the centre of the sphere."""
    la, lo = np.radians(lat), np.radians(lng)
    return EARTH_RADIUS_M * np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chord = np.sqrt(((a - b) ** 2).sum(axis=-1))
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, chord / (2 * EARTH_RADIUS_M)))


def noise(group: np.ndarray, t: np.ndarray, xyz: np.ndarray, max_speed: float) -> np.ndarray:
    """Pings reached from the ping before, and left to the ping after, only above ``max_speed`` m/s."""
    if len(t) < 3:
        return np.zeros(len(t), bool)
    fast = (great_circle(xyz[1:], xyz[:-1]) > max_speed * np.diff(t) / 1000.0) & (group[1:] == group[:-1])
    return np.concatenate([[False], fast]) & np.concatenate([fast, [False]])


def simplify(session: np.ndarray, t: np.ndarray, xyz: np.ndarray, tolerance: float) -> np.ndarray:
    """Time-synchronised Douglas-Peucker over all sessions at once: True at the pings retained.

    Every round measures each ping against the place on its segment that belongs
    to its time, and splits all segments that exceed the tolerance at their worst ping.
    """
    n = len(t)
    keep = np.zeros(n, bool)
    if not n:
        return keep
    edge = np.flatnonzero(session[1:] != session[:-1])
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [n - 1]])
    keep[first] = keep[last] = True
    while True:
        inner = last - first > 1
        first, last = first[inner], last[inner]
        if not len(first):
            return keep
        size = last - first - 1
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        seg = np.repeat(np.arange(len(first)), size)
        at = np.arange(len(seg)) - start[seg] + first[seg] + 1
        a, b = first[seg], last[seg]
        off = np.sqrt(((xyz[at] - interpolate(t, xyz, at, a, b)) ** 2).sum(axis=1))
        worst = np.maximum.reduceat(off, start)
        hit = np.flatnonzero(off == worst[seg])
        place = np.full(len(first), -1)
        place[seg[hit[::-1]]] = at[hit[::-1]]
        split = worst > tolerance
        first, mid, last = first[split], place[split], last[split]
        keep[mid] = True
        first, last = np.concatenate([first, mid]), np.concatenate([mid, last])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]


def interpolate(t, xyz, at, a, b) -> np.ndarray:
    span = (t[b] - t[a]).astype(float)
    share = np.divide(t[at] - t[a], span, out=np.zeros(len(at)), where=span > 0)
    return xyz[a] + (xyz[b] - xyz[a]) * share[:, None]


def low_speed(session: np.ndarray, t: np.ndarray, xyz: np.ndarray, keep: np.ndarray, min_ms: int, reach: float) -> np.ndarray:
    """Pings from which the simplified track gets no farther than ``reach`` in ``min_ms``.

    With ``reach`` twice the stop radius plus twice the tolerance no ping that
    begins a stop is missed: both ends of the hour lie within the radius of one
    place, and the simplified track within the tolerance of each.
    """
    n = len(t)
    kept = np.flatnonzero(keep)
    place = np.searchsorted(kept, np.arange(n), side="right") - 1
    a = kept[place]
    b = np.where(a == np.arange(n), a, kept[np.minimum(place + 1, len(kept) - 1)])
    s = interpolate(t, xyz, np.arange(n), a, b)
    order = session.astype(np.int64) * (1 << 43) + (t - t.min())
    m = np.searchsorted(order, order + min_ms)
    ok = (m < n) & (session[np.minimum(m, n - 1)] == session)
    m = np.minimum(m, n - 1)
    return ok & (np.sqrt(((s[m] - s) ** 2).sum(axis=1)) <= reach)


def slow_runs(session: np.ndarray, t: np.ndarray, xyz: np.ndarray, keep: np.ndarray, max_speed: float, min_pings: int, min_ms: int) -> np.ndarray:
    """(first, last) ping of the longest runs of simplified segments that are each passed at ``max_speed`` m/s at most."""
    kept = np.flatnonzero(keep)
    a, b = kept[:-1], kept[1:]
    inside = session[a] == session[b]
    slow = inside & (great_circle(xyz[a], xyz[b]) * 1000.0 <= max_speed * (t[b] - t[a]))
    edge = np.diff(np.concatenate([[0], (slow & inside).astype(np.int8), [0]]))
    # A run also ends where a session does, as segments across sessions are not slow.
    first, last = kept[np.flatnonzero(edge == 1)], kept[np.flatnonzero(edge == -1)]
    long = (last - first + 1 >= min_pings) & (t[last] - t[first] >= min_ms)
    return np.column_stack([first[long], last[long]])


def smallest_circle(p: np.ndarray) -> float:
    """Radius of the smallest circle around plane points: grown by the farthest point until none lies outside."""
    h = _hull(p)
    if len(h) == 1:
        return 0.0
    best = [0, 1]
    while True:
        c, r = _circle(h[best])
        d = np.hypot(*(h - c).T)
        far = int(d.argmax())
        if d[far] <= r * (1 + 1e-9) + 1e-9:
            return float(r)
        options = []
        members = [*best, far]
        for drop in (None, *range(len(best))):
            pick = [m for i, m in enumerate(members) if i != drop]
            for sub in ([pick] if len(pick) <= 3 else []) + [[x, far] for x in best]:
                cc, rr = _circle(h[sub])
                if (np.hypot(*(h[members] - cc).T) <= rr * (1 + 1e-9) + 1e-9).all():
                    options.append((rr, sub))
        best = min(options, key=lambda o: o[0])[1]


def _circle(p: np.ndarray) -> tuple[np.ndarray, float]:
    """The smallest circle that has two or three points inside or on it."""
    if len(p) == 2:
        return p.mean(axis=0), float(np.hypot(*(p[0] - p[1]))) / 2
    for i in range(3):
        a, b, c = p[i], p[(i + 1) % 3], p[(i + 2) % 3]
        m, r = (a + b) / 2, np.hypot(*(a - b)) / 2
        if np.hypot(*(c - m)) <= r * (1 + 1e-12):
            return m, float(r)
    (ax, ay), (bx, by), (cx, cy) = p
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    ux = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d
    uy = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d
    centre = np.array([ux, uy])
    return centre, float(np.hypot(*(p[0] - centre)))


def _hull(p: np.ndarray) -> np.ndarray:
    """Convex hull by the monotone chain; extreme points first cut long inputs down."""
    q = np.unique(p, axis=0)
    if len(q) > 64:
        turn = np.linspace(0, np.pi, 64, endpoint=False)
        proj = q @ np.array([np.cos(turn), np.sin(turn)])
        ring = q[np.unique(np.concatenate([proj.argmax(axis=0), proj.argmin(axis=0)]))]
        c = ring.mean(axis=0)
        # Points inside the circle that all 64 supporting strips share cannot be extreme.
        safe = min(float((proj.max(axis=0) - c @ np.array([np.cos(turn), np.sin(turn)])).min()), float((c @ np.array([np.cos(turn), np.sin(turn)]) - proj.min(axis=0)).min())) * math.cos(np.pi / 64) * 0.5
        q = q[np.hypot(*(q - c).T) >= safe]
    if len(q) <= 2:
        return q
    out = []
    for pts in (q, q[::-1]):
        chain: list = []
        for x, y in pts.tolist():
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (y - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (x - chain[-2][0]) <= 0:
                chain.pop()
            chain.append((x, y))
        out += chain[:-1]
    return np.array(out)


class RunFinder:
    """Longest runs of one session whose pings all lie within ``radius`` of one place."""

    def __init__(self, lat: np.ndarray, lng: np.ndarray, radius: float):
        self.lat, self.lng, self.radius = lat, lng, radius

    def _plane(self, i: int, j: int) -> np.ndarray:
        la, dl = self.lat[i : j + 1], (self.lng[i : j + 1] - self.lng[i] + 180) % 360 - 180
        return np.column_stack([np.radians(dl) * math.cos(math.radians(self.lat[i])), np.radians(la - self.lat[i])]) * EARTH_RADIUS_M

    def fits(self, i: int, j: int) -> bool:
        p = self._plane(i, j)
        lo, hi = p.min(axis=0), p.max(axis=0)
        if (hi - lo).max() > 2 * self.radius:
            return False
        if np.hypot(*(p - (lo + hi) / 2).T).max() <= self.radius:
            return True
        return smallest_circle(p) <= self.radius * (1 + 1e-9)

    def end(self, i: int, stop: int) -> int:
        """Last ping, below ``stop``, of the run that begins at i: growing steps, then halving."""
        good, step = i, 8
        while good + 1 < stop:
            j = min(good + step, stop - 1)
            if self.fits(i, j):
                good, step = j, step * 2
                continue
            lo, hi = good, j
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if self.fits(i, mid) else (lo, mid)
            return lo
        return good


def find_stops(t: np.ndarray, lat: np.ndarray, lng: np.ndarray, candidate: np.ndarray, radius: float, min_pings: int, min_ms: int) -> list[tuple[int, int]]:
    """(first, last) ping of the stops of one session, longest run first where runs overlap."""
    finder = RunFinder(lat, lng, radius)
    out: list[tuple[int, int]] = []
    todo = [(0, len(t))]
    while todo:
        a, b = todo.pop()
        i = a
        while i < b:
            if not candidate[i]:
                nxt = candidate[i:b].argmax()
                if not candidate[i + nxt]:
                    break
                i += int(nxt)
            j = finder.end(i, b)
            if j - i + 1 < min_pings or t[j] - t[i] < min_ms:
                i += 1
                continue
            # A run that begins later may be longer only if it takes in the next ping.
            best_i, best_j = i, j
            k = i + 1
            while best_j + 1 < b and k <= best_j:
                if finder.fits(k, best_j + 1):
                    e = finder.end(k, b)
                    if e - k > best_j - best_i:
                        best_i, best_j = k, e
                    elif not finder.fits(best_j, best_j + 1):
                        break
                    else:
                        k += 1
                        continue
                elif not finder.fits(best_j, best_j + 1):
                    break
                k += 1
            out.append((best_i, best_j))
            if best_i - i >= min_pings:
                todo.append((i, best_i))
            i = best_j + 1
    return sorted(out)
