"""Shape measures that need a hull or an order of vertices: Arrow functions on whole batches.

Spark spreads the footprints over tasks; each function sees one Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

HULL_STRUCT = ("hull_area double, hull_perimeter double, mrr_long_side_m double, "
               "mrr_short_side_m double, orientation_deg double, max_diameter_m double, "
               "vertex_count int")


def ring_array(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], dtype=float)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without repeated or collinear points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out = []
        for p in rows:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append(tuple(p))
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def closed_length(points: np.ndarray) -> float:
    step = np.roll(points, -1, axis=0) - points
    return float(np.hypot(step[:, 0], step[:, 1]).sum())


def closed_area(points: np.ndarray) -> float:
    nxt = np.roll(points, -1, axis=0)
    return float(abs((points[:, 0] * nxt[:, 1] - nxt[:, 0] * points[:, 1]).sum()) / 2)


def min_rectangle(h: np.ndarray) -> tuple[float, float, float]:
    """Long side, short side and direction of the smallest rectangle around a hull."""
    if len(h) < 3:
        if len(h) < 2:
            return 1e-9, 1e-9, 0.0
        d = h[1] - h[0]
        return float(np.hypot(*d)), 1e-9, float(np.degrees(np.arctan2(d[1], d[0])) % 180)
    step = np.roll(h, -1, axis=0) - h
    angle = np.arctan2(step[:, 1], step[:, 0])
    u = np.stack([np.cos(angle), np.sin(angle)])
    v = np.stack([-u[1], u[0]])
    along, across = h @ u, h @ v
    w, d = np.ptp(along, axis=0), np.ptp(across, axis=0)
    best = int(np.argmin(np.round(w * d, 9)))
    turn = 0.0 if w[best] >= d[best] else 90.0
    direction = (np.degrees(angle[best]) + turn) % 180
    return (max(float(max(w[best], d[best])), 1e-9), max(float(min(w[best], d[best])), 1e-9),
            float(direction))


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Keep the ends and every vertex that is further than the tolerance from its chord."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base, mid = points[b] - points[a], points[a + 1:b] - points[a]
        norm2 = float(base @ base)
        t = np.clip(mid @ base / norm2, 0, 1) if norm2 > 0 else np.zeros(len(mid))
        off = mid - t[:, None] * base
        dist = np.hypot(off[:, 0], off[:, 1])
        far = int(np.argmax(dist))
        if dist[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return points[keep]


def simplify_closed(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring is split at the vertex farthest from its start, then both halves."""
    body = points[:-1] if len(points) > 1 and np.allclose(points[0], points[-1]) else points
    if len(body) < 4:
        return points
    far = int(np.argmax(((body - body[0]) ** 2).sum(axis=1)))
    first = simplify_line(body[:far + 1], tolerance)
    second = simplify_line(np.vstack([body[far:], body[:1]]), tolerance)
    return np.vstack([first[:-1], second])


def hull_measures(rings):
    """Hull, smallest rectangle, largest diameter and simplified vertex count."""
    names = [part.split()[0] for part in HULL_STRUCT.split(", ")]

    @F.pandas_udf(HULL_STRUCT)
    def measure(polygons: pd.Series) -> pd.DataFrame:
        rows = []
        for polygon in polygons:
            pts = ring_array(polygon[0])
            h = hull(pts)
            long_side, short_side, direction = min_rectangle(h)
            gap = h[:, None, :] - h[None, :, :]
            rows.append((closed_area(h), closed_length(h), long_side, short_side, direction,
                         float(np.sqrt((gap ** 2).sum(axis=2)).max()),
                         len(simplify_closed(pts, 0.5)) - 1))
        return pd.DataFrame(rows, columns=names)

    return measure(rings)


def simplify_rings(tolerance: float):
    """Simplified outer rings as an Arrow function."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def simplified(rings: pd.Series) -> pd.Series:
        out = []
        for ring in rings:
            pts = simplify_closed(ring_array(ring), tolerance)
            out.append([{"x": float(x), "y": float(y)} for x, y in pts])
        return pd.Series(out)

    return simplified


def clipped_area(subject: np.ndarray, window: np.ndarray) -> float:
    """Area of a polygon clipped to a convex polygon, by half planes; rings without repeat."""
    pts, nxt = subject, np.roll(window, -1, axis=0)
    if (window[:, 0] * nxt[:, 1] - nxt[:, 0] * window[:, 1]).sum() < 0:
        window = window[::-1]
        nxt = np.roll(window, -1, axis=0)
    for p, q in zip(window, nxt):
        if len(pts) == 0:
            break
        side = (q[0] - p[0]) * (pts[:, 1] - p[1]) - (q[1] - p[1]) * (pts[:, 0] - p[0])
        kept = []
        for i in range(len(pts)):
            j = (i + 1) % len(pts)
            if side[i] >= 0:
                kept.append(pts[i])
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                kept.append(pts[i] + side[i] / (side[i] - side[j]) * (pts[j] - pts[i]))
        pts = np.array(kept).reshape(-1, 2)
    return closed_area(pts) if len(pts) > 2 else 0.0


def turns(window: np.ndarray) -> np.ndarray:
    """Cross product at every corner of a ring without repeat."""
    a, b = window - np.roll(window, 1, axis=0), np.roll(window, -1, axis=0) - window
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def simple_overlap(subject: np.ndarray, window: np.ndarray) -> float:
    """Area of a polygon inside a simple polygon.

    A window that is not convex counts as the signed sum of the triangles of its edges and its
    first corner, each of which is convex.
    """
    turn = turns(window)
    if (turn >= 0).all() or (turn <= 0).all():
        return clipped_area(subject, window)
    total = 0.0
    for p, q in zip(window[1:-1], window[2:]):
        triangle = np.array([window[0], p, q])
        total += np.sign(turns(triangle)[0]) * clipped_area(subject, triangle)
    return abs(total)


def polygon_overlap(subject, clip):
    """Exact area of a ring inside another simple ring."""

    @F.pandas_udf("double")
    def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([simple_overlap(ring_array(s)[:-1], ring_array(w)[:-1])
                          for s, w in zip(a, b)])

    return overlap(subject, clip)


def wkb_point(wkb):
    """Coordinates of point geometries in well-known binary."""

    @F.pandas_udf("struct<x:double,y:double>")
    def decode(values: pd.Series) -> pd.DataFrame:
        xy = [np.frombuffer(b, dtype="<f8" if b[0] == 1 else ">f8", count=2, offset=5)
              if b is not None else (np.nan, np.nan) for b in values]
        return pd.DataFrame(np.array(xy).reshape(-1, 2), columns=["x", "y"])

    return decode(wkb)


GAP_PAIRS = 1 << 18  # pairs of edges that are compared at once


def listed_edges(lists) -> tuple[np.ndarray, np.ndarray]:
    """How many edges each outline of an Arrow list has (0 if null), and x1, y1, x2, y2 of all of them."""
    flat = lists.flatten()
    parts = dict(zip((f.name for f in flat.type), flat.flatten()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.array([parts[c].to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")], dtype=float)


def point_gap2(s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dx, dy = s[2] - s[0], s[3] - s[1]
    len2 = dx * dx + dy * dy
    t = np.where(len2 > 0, ((x - s[0]) * dx + (y - s[1]) * dy) / len2, 0.0)
    t = np.minimum(np.maximum(t, 0.0), 1.0)
    ex, ey = x - (s[0] + t * dx), y - (s[1] + t * dy)
    return ex * ex + ey * ey


def apart(s: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether two points lie on different sides of a line."""
    side = lambda x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    return side(x1, y1) * side(x2, y2) < 0


def odd_crossings(sizes: np.ndarray, s: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the point of each outline lies inside it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    x, y = x[of], y[of]
    hit = ((s[1] > y) != (s[3] > y)) & (x < (s[2] - s[0]) * (y - s[1]) / (s[3] - s[1]) + s[0])
    return np.bincount(of[hit], minlength=len(sizes)) % 2 == 1


def gaps_of_pairs(an: np.ndarray, a: np.ndarray, bn: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of outlines given as edges, 0 when they touch, cross or contain each other; NaN without edges."""
    gap2, crossed = np.full(len(an), np.inf), np.zeros(len(an), bool)
    pair, b_at, a_at = np.repeat(np.arange(len(an)), an), np.cumsum(bn) - bn, np.cumsum(an) - an
    end = np.cumsum(bn[pair])
    start = 0
    while start < len(pair):  # an edge of a meets all edges of b
        done = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, done + GAP_PAIRS, "right")))
        m = bn[pair[start:stop]]
        of = np.repeat(pair[start:stop], m)
        s = np.repeat(a[:, start:stop], m, axis=1)
        o = b[:, b_at[of] + np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)]
        near = np.fmin(np.fmin(point_gap2(s, o[0], o[1]), point_gap2(s, o[2], o[3])),
                       np.fmin(point_gap2(o, s[0], s[1]), point_gap2(o, s[2], s[3])))
        np.fmin.at(gap2, of, near)
        crossed[of[apart(s, *o) & apart(o, *s)]] = True
        start = stop
    both = (an > 0) & (bn > 0)
    first = lambda edges, at: edges[:2, np.minimum(at, edges.shape[1] - 1)] if edges.shape[1] else np.zeros((2, len(at)))
    inside = odd_crossings(an, a, *first(b, b_at)) | odd_crossings(bn, b, *first(a, a_at))
    return np.where(both, np.where(crossed | inside, 0.0, np.sqrt(gap2)), np.nan)


def outline_gap(edges_a, edges_b):
    """Geo.polygon_gap on Arrow batches: no formula is worked out edge by edge."""
    @F.arrow_udf("double")
    def gap(a: pa.Array, b: pa.Array) -> pa.Array:
        with np.errstate(divide="ignore", invalid="ignore"):
            found = gaps_of_pairs(*listed_edges(a), *listed_edges(b))
        return pa.array(found, pa.float64(), mask=np.isnan(found))

    return gap(edges_a, edges_b)
