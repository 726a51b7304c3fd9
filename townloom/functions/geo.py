"""Geometry measures as Column expressions.

A ring is ARRAY<STRUCT<x DOUBLE, y DOUBLE>> and closed; a polygon is ARRAY<ring> with the
outer ring first and holes after it. Coordinates are metres in the district frame unless a
function says otherwise. Nothing here needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
POLYGON = f"array<{RING}>"


def c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def let(value: Column, body) -> Column:
    """Evaluate a value once and use it many times inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x, y) -> Column:
    return F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))


def ring_from(*xy) -> Column:
    """A ring from (x, y) pairs; the first point must be repeated at the end."""
    return F.array(*[point(x, y) for x, y in xy])


def segments(line) -> Column:
    """Consecutive vertices of a ring or line as structs x1, y1, x2, y2."""
    line = c(line)
    n = F.size(line)
    return F.zip_with(
        F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"),
                              b["x"].alias("x2"), b["y"].alias("y2")))


def edges(rings) -> Column:
    """All edges of a polygon, holes included."""
    return F.flatten(F.transform(c(rings), segments))


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, s: acc + f(s))


def cross(s) -> Column:
    return s["x1"] * s["y2"] - s["x2"] * s["y1"]


def ring_area(ring) -> Column:
    return F.abs(_sum(segments(ring), cross)) / 2.0


def area(rings) -> Column:
    """G1: outer ring minus holes, whatever the winding."""
    rings = c(rings)
    holes = F.aggregate(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))),
                        F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return ring_area(rings[0]) - holes


def segment_length(s) -> Column:
    return F.sqrt((s["x2"] - s["x1"]) * (s["x2"] - s["x1"])
                  + (s["y2"] - s["y1"]) * (s["y2"] - s["y1"]))


def line_length(line) -> Column:
    return _sum(segments(line), segment_length)


def perimeter(rings) -> Column:
    return _sum(edges(rings), segment_length)


def bbox(rings) -> Column:
    ring = c(rings)[0]
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def centroid(rings) -> Column:
    """Area-weighted centroid; holes count against the outer ring whatever their winding."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, s):
        return let(cross(s), lambda k: F.struct(
            (acc["a"] + k).alias("a"), (acc["mx"] + (s["x1"] + s["x2"]) * k).alias("mx"),
            (acc["my"] + (s["y1"] + s["y2"]) * k).alias("my")))

    def oriented(ring, i):
        # the outer ring counts positive, holes negative
        return let(F.aggregate(segments(ring), zero, add), lambda m: let(
            F.signum(m["a"]) * F.when(i == 0, 1.0).otherwise(-1.0),
            lambda f: F.struct((m["a"] * f).alias("a"), (m["mx"] * f).alias("mx"),
                               (m["my"] * f).alias("my"))))

    total = F.aggregate(F.transform(c(rings), oriented), zero, lambda acc, m: F.struct(
        (acc["a"] + m["a"]).alias("a"), (acc["mx"] + m["mx"]).alias("mx"),
        (acc["my"] + m["my"]).alias("my")))
    return let(total, lambda t: F.struct((t["mx"] / (t["a"] * 3.0)).alias("x"),
                                         (t["my"] / (t["a"] * 3.0)).alias("y")))


def contains(edge_list, x, y) -> Column:
    """Even-odd test against all edges, so holes are respected."""
    # the point is bound outside the edge loop, or its own expression would run per edge
    def odd(p):
        crossing = F.filter(c(edge_list), lambda s: (
            (s["y1"] > p["y"]) != (s["y2"] > p["y"])) & (
            p["x"] < (s["x2"] - s["x1"]) * (p["y"] - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
        return F.size(crossing) % 2 == 1

    return let(point(x, y), odd)


def point_segment_distance2(s, x, y) -> Column:
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / len2).otherwise(F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (s["x1"] + t * dx), y - (s["y1"] + t * dy)
    return ex * ex + ey * ey


def distance_to_edges(edge_list, x, y) -> Column:
    return let(point(x, y), lambda p: F.sqrt(F.array_min(F.transform(
        c(edge_list), lambda s: point_segment_distance2(s, p["x"], p["y"])))))


def distance(edge_list, x, y) -> Column:
    """Distance from a point to a polygon, 0 inside."""
    return let(c(edge_list), lambda e: let(point(x, y), lambda p: F.when(
        contains(e, p["x"], p["y"]), F.lit(0.0)).otherwise(
        distance_to_edges(e, p["x"], p["y"]))))


def segment_gap2(s, o) -> Column:
    """Squared distance of two segments that do not cross."""
    return F.least(point_segment_distance2(s, o["x1"], o["y1"]),
                   point_segment_distance2(s, o["x2"], o["y2"]),
                   point_segment_distance2(o, s["x1"], s["y1"]),
                   point_segment_distance2(o, s["x2"], s["y2"]))


def _side(s, x, y) -> Column:
    return (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])


def segments_cross(s, o) -> Column:
    return ((_side(s, o["x1"], o["y1"]) * _side(s, o["x2"], o["y2"]) < 0)
            & (_side(o, s["x1"], s["y1"]) * _side(o, s["x2"], s["y2"]) < 0))


def polygon_gap(edges_a, edges_b) -> Column:
    """Distance of two footprints, 0 when they touch, cross or contain each other."""
    a, b = c(edges_a), c(edges_b)
    touching = F.exists(a, lambda s: F.exists(b, lambda o: segments_cross(s, o)))
    nested = (contains(a, b[0]["x1"], b[0]["y1"]) | contains(b, a[0]["x1"], a[0]["y1"]))
    gap = F.sqrt(F.array_min(F.transform(
        a, lambda s: F.array_min(F.transform(b, lambda o: segment_gap2(s, o))))))
    return F.when(touching | nested, F.lit(0.0)).otherwise(gap)


def arc_position(ring, x, y) -> Column:
    """Distance along a ring to its point nearest to (x, y); the first nearest wins.

    Squared distances that agree to six decimals are equally near.
    """
    inf = F.lit(float("inf"))
    start = F.struct(F.lit(0.0).alias("walked"), inf.alias("best"), F.lit(0.0).alias("at"))

    def step(acc, s, x, y):
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, ((x - s["x1"]) * dx + (y - s["y1"]) * dy) / len2).otherwise(
            F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        d2 = F.round(point_segment_distance2(s, x, y), 6)
        length = F.sqrt(len2)
        closer = d2 < acc["best"]
        return F.struct((acc["walked"] + length).alias("walked"),
                        F.when(closer, d2).otherwise(acc["best"]).alias("best"),
                        F.when(closer, acc["walked"] + t * length).otherwise(acc["at"])
                        .alias("at"))

    return let(point(x, y), lambda p: F.aggregate(
        segments(ring), start, lambda acc, s: step(acc, s, p["x"], p["y"]))["at"])


def bearing(x1, y1, x2, y2) -> Column:
    """C20: compass bearing in degrees, 0 is north and 90 is east."""
    degrees = F.degrees(F.atan2(c(y2) - c(y1), c(x2) - c(x1)))
    return F.pmod(F.lit(90.0) - degrees, F.lit(360.0))


def sector(bearing_deg) -> Column:
    return F.floor(F.pmod(c(bearing_deg) + 22.5, F.lit(360.0)) / 45.0).cast("int")


def compass(sector_no) -> Column:
    from townloom.functions.vocab import COMPASS

    return F.array(*[F.lit(v) for v in COMPASS])[sector_no]


def haversine(lat1, lon1, lat2, lon2, radius: float = 6371000.0) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dp, dl = F.radians(c(lat2) - c(lat1)), F.radians(c(lon2) - c(lon1))
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(dl / 2), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(a))


def span_metres(lon_span, lat_span, mid_lat) -> Column:
    """Width and height in metres of a small box given in degrees."""
    return F.struct((c(lon_span) * 111320.0 * F.cos(F.radians(c(mid_lat)))).alias("w"),
                    (c(lat_span) * 110540.0).alias("h"))


def axis_position(ax, ay, angle_deg, x, y) -> Column:
    """Position along an axis through (ax, ay) and the signed offset, left positive."""
    ux, uy = F.cos(F.radians(c(angle_deg))), F.sin(F.radians(c(angle_deg)))
    dx, dy = c(x) - c(ax), c(y) - c(ay)
    return F.struct((dx * ux + dy * uy).alias("s"), (dy * ux - dx * uy).alias("perp"))


def half_extent(xmin, ymin, xmax, ymax, target_km2=4.0) -> Column:
    """Half side of the square canvas around a boundary."""
    target = F.least(F.greatest(c(target_km2) if not isinstance(target_km2, (int, float))
                                else F.lit(float(target_km2)), F.lit(1.0)), F.lit(12.0))
    return F.greatest(F.sqrt(target * 1000000.0) / 2.0, (c(xmax) - c(xmin)) / 2.0,
                      (c(ymax) - c(ymin)) / 2.0)


def cell_of(v, size: float) -> Column:
    return F.floor(c(v) / F.lit(float(size))).cast("long")


def cell_centre(i, size: float) -> Column:
    return (c(i) + F.lit(0.5)) * F.lit(float(size))


# --- projections (C30): published series, WGS84 / GRS80 ------------------------------------

_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)


def utm_zone(lon) -> Column:
    return (F.floor((c(lon) + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lon, lat) -> Column:
    return F.when(c(lat) >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon))


def utm_forward(lon, lat, zone=None) -> Column:
    """Forward transverse Mercator (Snyder's series) in the zone of the point or a given one."""
    lon, lat = c(lon), c(lat)
    zone = utm_zone(lon) if zone is None else c(zone)
    lon0 = F.radians(zone * 6.0 - 183.0)
    phi, lam = F.radians(lat), F.radians(lon)
    ep2 = _E2 / (1 - _E2)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(_A) / F.sqrt(1.0 - _E2 * sin * sin)
    t, cc = tan * tan, ep2 * cos * cos
    a = (lam - lon0) * cos
    e4, e6 = _E2 ** 2, _E2 ** 3
    m = F.lit(_A) * ((1 - _E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
                     - (3 * _E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2.0 * phi)
                     + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4.0 * phi)
                     - (35 * e6 / 3072) * F.sin(6.0 * phi))
    p = lambda k: F.pow(a, F.lit(float(k)))
    x = 0.9996 * n * (a + (1.0 - t + cc) * p(3) / 6.0
                      + (5.0 - 18.0 * t + t * t + 72.0 * cc - 58 * ep2) * p(5) / 120.0)
    y = 0.9996 * (m + n * tan * (
        p(2) / 2.0 + (5.0 - t + 9.0 * cc + 4.0 * cc * cc) * p(4) / 24.0
        + (61.0 - 58.0 * t + t * t + 600.0 * cc - 330 * ep2) * p(6) / 720.0))
    return F.struct((x + 500000.0).alias("x"),
                    F.when(lat < 0, y + 10000000.0).otherwise(y).alias("y"))


def albers_forward(lon, lat, lon0=-96.0, lat0=23.0, p1=29.5, p2=45.5) -> Column:
    """Albers equal-area conic with the parameters of the contiguous United States."""
    import math

    e = math.sqrt(_E2)

    def q_num(phi):
        s = math.sin(phi)
        return (1 - _E2) * (s / (1 - _E2 * s * s)
                            - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))

    def m_num(phi):
        return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)

    r1, r2, r0 = math.radians(p1), math.radians(p2), math.radians(lat0)
    n = (m_num(r1) ** 2 - m_num(r2) ** 2) / (q_num(r2) - q_num(r1))
    cc = m_num(r1) ** 2 + n * q_num(r1)
    rho0 = _A * math.sqrt(cc - n * q_num(r0)) / n
    s = F.sin(F.radians(c(lat)))
    q = (1 - _E2) * (s / (1.0 - _E2 * s * s)
                     - (1 / (2 * e)) * F.log((1.0 - e * s) / (1.0 + e * s)))
    rho = F.lit(_A) * F.sqrt(F.lit(cc) - n * q) / n
    theta = n * (F.radians(c(lon)) - math.radians(lon0))
    return F.struct((rho * F.sin(theta)).alias("x"),
                    (F.lit(rho0) - rho * F.cos(theta)).alias("y"))


# --- polygon moments (G7) --------------------------------------------------------------------


def hu_moments(rings) -> Column:
    """The seven invariants of the outer ring from exact polygon moments up to order 3.

    The moments are line integrals over the edges (Green's theorem), so no raster is needed.
    """
    import math

    orders = [(0, 0), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]

    def moment(seg, p, q):
        def term(s):
            total = F.lit(0.0)
            for k in range(p + 1):
                for m in range(q + 1):
                    part = F.lit(float(math.comb(k + m, m) * math.comb(p + q - k - m, q - m)))
                    for base, power in ((s["x2"], k), (s["x1"], p - k), (s["y2"], m),
                                        (s["y1"], q - m)):
                        for _ in range(power):
                            part = part * base
                    total = total + part
            return cross(s) * total
        return _sum(seg, term) / float((p + q + 2) * (p + q + 1) * math.comb(p + q, p))

    def shifted(seg, ctr):
        return F.transform(seg, lambda s: F.struct(
            (s["x1"] - ctr["x"]).alias("x1"), (s["y1"] - ctr["y"]).alias("y1"),
            (s["x2"] - ctr["x"]).alias("x2"), (s["y2"] - ctr["y"]).alias("y2")))

    def normalised(seg):
        raw = F.array(*[moment(seg, p, q) for p, q in orders])
        # the winding flips the sign of every moment alike
        return let(raw, lambda m: F.array(*[
            F.signum(m[0]) * m[i] / F.pow(F.abs(m[0]), F.lit(1 + (p + q) / 2.0))
            for i, (p, q) in enumerate(orders)]))

    def invariants(n):
        n20, n11, n02, n30, n21, n12, n03 = [n[i] for i in range(1, 8)]
        a, b = n30 + n12, n21 + n03
        d, e = n30 - 3.0 * n12, 3.0 * n21 - n03
        h = [n20 + n02,
             (n20 - n02) * (n20 - n02) + 4.0 * n11 * n11,
             d * d + e * e,
             a * a + b * b,
             d * a * (a * a - 3.0 * b * b) + e * b * (3.0 * a * a - b * b),
             (n20 - n02) * (a * a - b * b) + 4.0 * n11 * a * b,
             e * a * (a * a - 3.0 * b * b) - d * b * (3.0 * a * a - b * b)]
        return F.transform(F.array(*h), lambda v: -F.signum(v) * F.log10(F.abs(v) + F.lit(1e-30)))

    ring = F.array(c(rings)[0])
    return let(shifted(segments(c(rings)[0]), centroid(ring)),
               lambda seg: let(normalised(seg), invariants))
