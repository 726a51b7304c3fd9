import numpy as np
import pytest
from pyspark.sql import functions as F

from townloom.functions import geo, shapes
from townloom.operators import programs, spatial

SQUARE_WITH_HOLE = [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)],
                    [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]]
ARROW = [[(0, 0), (10, 0), (10, 10), (5, 3), (0, 10), (0, 0)]]


def polygons(spark, *polys):
    rows = [(i, 0, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p])
            for i, p in enumerate(polys)]
    return spark.createDataFrame(rows, f"pid int, district_id int, rings {geo.POLYGON}")


def turned(poly, angle, dx=0.0, dy=0.0, scale=1.0):
    c, s = np.cos(angle), np.sin(angle)
    return [[((x * c - y * s) * scale + dx, (x * s + y * c) * scale + dy) for x, y in ring] for ring in poly]


def test_area_and_hole(spark):
    flipped = [SQUARE_WITH_HOLE[0], SQUARE_WITH_HOLE[1][::-1]]
    df = polygons(spark, SQUARE_WITH_HOLE, flipped, ARROW)
    r = df.select("pid", geo.area("rings").alias("a"), geo.perimeter("rings").alias("p"),
                  geo.centroid("rings").alias("c")).orderBy("pid").collect()
    assert [x.a for x in r] == [96.0, 96.0, 65.0]
    assert r[0].p == 48.0 and r[0].c.x == pytest.approx(5) and r[1].c.y == pytest.approx(5)


def test_point_in_polygon_with_hole(spark):
    df = polygons(spark, SQUARE_WITH_HOLE)
    for (x, y), want in {(5, 5): False, (1, 1): True, (11, 5): False, (3.9, 5): True}.items():
        assert df.select(geo.contains(geo.edges("rings"), F.lit(float(x)), F.lit(float(y))).alias("i")
                         ).first().i is want


def test_distance_and_gap(spark):
    df = polygons(spark, SQUARE_WITH_HOLE)
    d = lambda x, y: df.select(geo.distance(geo.edges("rings"), F.lit(x), F.lit(y)).alias("d")).first().d
    assert d(13.0, 14.0) == 5.0 and d(1.0, 1.0) == 0.0 and d(5.0, 5.0) == 1.0
    two = polygons(spark, [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]],
                   [[(4, 5), (6, 5), (6, 7), (4, 7), (4, 5)]], [[(-1, -1), (9, -1), (9, 9), (-1, 9), (-1, -1)]])
    e = two.select("pid", geo.edges("rings").alias("e"))
    pair = e.alias("a").join(e.alias("b"), F.expr("a.pid < b.pid")).select(
        F.col("a.pid").alias("i"), F.col("b.pid").alias("j"), geo.polygon_gap("a.e", "b.e").alias("g"))
    assert {(r.i, r.j): r.g for r in pair.collect()} == {(0, 1): 5.0, (0, 2): 0.0, (1, 2): 0.0}


def test_shape_measures_do_not_depend_on_rotation(spark):
    rng = np.random.default_rng(1)
    polys = [turned(ARROW, a, *rng.uniform(-50, 50, 2)) for a in (0, 0.3, 1.1, 2.7)]
    df = programs.add_hull_measures(programs.add_shape_measures(polygons(spark, *polys)))
    rows = df.orderBy("pid").collect()
    for c in ("area_m2", "perimeter_m", "compactness", "hull_ratio", "roughness", "mrr_long_side_m",
              "mrr_short_side_m", "max_diameter_m", "hu_1", "hu_2"):
        assert [r[c] for r in rows] == pytest.approx([rows[0][c]] * 4, rel=1e-6), c
    assert rows[0].hull_ratio == pytest.approx(0.65) and rows[0].vertex_count == 5


def test_hu_moments_scale_and_winding(spark):
    polys = [ARROW, turned(ARROW, 0.8, 5, 7, 3.0), [ARROW[0][::-1]]]
    h = polygons(spark, *polys).select("pid", geo.hu_moments("rings").alias("h")).orderBy("pid").collect()
    for i in range(4):
        assert [r.h[i] for r in h] == pytest.approx([h[0].h[i]] * 3, rel=1e-6)


def test_clipping_against_grid():
    a = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert shapes.clipped_area(a, np.array([(2, 2), (6, 2), (6, 6), (2, 6)], float)) == pytest.approx(4)
    assert shapes.clipped_area(a, np.array([(2, -1), (5, 2), (2, 5), (-1, 2)], float)) == pytest.approx(14)
    assert shapes.clipped_area(a, np.array([(9, 9), (9, 10), (10, 10)], float)) == 0


def test_exact_and_cell_overlap_agree(spark):
    from townloom.plans.fixtures import Layers

    lay = Layers(spark, "/root/testdata/sf0.001")
    exact = spatial.overlap_exact(lay.units().select("district_id", "unit_id", "rings"), lay.boundaries(), "unit_id")
    cells = spatial.overlap_by_cells(lay.units(), lay.boundaries(), "unit_id", 5.0)
    worst = exact.join(cells.withColumnRenamed("overlap_ratio", "r"), "unit_id").agg(
        F.max(F.abs(F.col("overlap_ratio") - F.col("r"))).alias("d")).first().d
    assert worst < 0.02


def test_projection_known_points(spark):
    # zone 31 at the central meridian: x is 500 km; 0.9996 times the meridian arc to 45 degrees
    u = spark.range(1).select(geo.utm_forward(F.lit(3.0), F.lit(45.0)).alias("u")).first().u
    assert u.x == pytest.approx(500000, abs=1e-3) and u.y == pytest.approx(4982950.4, abs=0.5)
    s = spark.range(1).select(geo.utm_epsg(F.lit(-43.2), F.lit(-22.9)).alias("e")).first().e
    assert s == 32723
    a = spark.range(1).select(geo.albers_forward(F.lit(-96.0), F.lit(23.0)).alias("a")).first().a
    assert abs(a.x) < 1e-6 and abs(a.y) < 1e-6


def test_simplification_keeps_shape():
    circle = np.array([(np.cos(t), np.sin(t)) for t in np.linspace(0, 2 * np.pi, 200)])
    circle[-1] = circle[0]
    s = shapes.simplify_closed(circle * 100, 1.0)
    assert 10 < len(s) < 60 and shapes.closed_area(s[:-1]) == pytest.approx(np.pi * 1e4, rel=0.03)


def test_tile_join_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    polys = [turned(ARROW, rng.uniform(0, 6), *rng.uniform(0, 300, 2), rng.uniform(0.5, 8)) for _ in range(40)]
    pg = polygons(spark, *polys)
    pts = [(i, 0, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 330, (600, 2)))]
    pt = spark.createDataFrame(pts, "id int, district_id int, x double, y double")

    def inside(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {(i, j) for i, _, x, y in pts for j, p in enumerate(polys) if inside(p[0], x, y)}
    for tile, hot in ((40.0, None), (500.0, 50), (75.0, 5)):
        got = spatial.spatial_join(pt, pg, ["pid"], tile=tile, force_rows=hot).select("id", "pid").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    left = spatial.spatial_join(pt, pg, ["pid"], "left", tile=60.0, force_rows=20)
    assert left.where("pid is null").count() == 600 - len({i for i, _ in want})
    d = spatial.spatial_join(pt, pg, ["pid"], within=9.0, tile=30.0, distance_as="d")
    assert {(r.id, r.pid) for r in d.where("d = 0").collect()} == want


def test_arc_position_takes_the_first_of_equally_near_sides(spark):
    """Places on a diagonal of the octagon are as near to two sides, but for the last bit of the distances."""
    r, h = 337.0, 235.0
    ring = [(500 + r, 500.0), (500 + h, 500 + h), (500.0, 500 + r), (500 - h, 500 + h), (500 - r, 500.0),
            (500 - h, 500 - h), (500.0, 500 - r), (500 + h, 500 - h), (500 + r, 500.0)]
    pts = [(500.0 + a, 500.0 + b) for a in np.arange(-240, 240, 7.75) for b in (a, -a)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring], float(x), float(y)) for x, y in pts],
                               f"ring {geo.POLYGON[6:-1]}, x double, y double")
    got = [v.a for v in df.select(geo.arc_position("ring", "x", "y").alias("a")).collect()]
    for (x, y), at in zip(pts, got):
        best, walked, want = None, 0.0, None
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            dx, dy = x2 - x1, y2 - y1
            t = min(max(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0), 1)
            d2 = (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2
            if best is None or d2 < best - 1e-7:
                best, want = d2, walked + t * np.hypot(dx, dy)
            walked += np.hypot(dx, dy)
        assert at == pytest.approx(want)


def test_gaps_of_batches_equal_the_formula(spark):
    """Footprint pairs were measured by a formula that is interpreted edge by edge."""
    rng = np.random.default_rng(8)
    polys = [turned(p, rng.uniform(0, 6), *rng.uniform(0, 40, 2), rng.uniform(0.2, 2)) for p in (SQUARE_WITH_HOLE, ARROW) * 8]
    polys += [SQUARE_WITH_HOLE, [[(x * 0.1 + 4.5, y * 0.1 + 4.5) for x, y in ARROW[0]]], [[(x + 10, y) for x, y in SQUARE_WITH_HOLE[0]]]]
    p = polygons(spark, *polys).withColumn("e", geo.edges("rings"))
    pairs = p.alias("a").crossJoin(p.alias("b"))
    both = pairs.select(geo.polygon_gap("a.e", "b.e").alias("g"), shapes.outline_gap("a.e", "b.e").alias("f")).collect()
    assert len(both) == len(polys) ** 2 and 0 < sum(r.g > 0 for r in both) < len(both)
    assert all(r.g == r.f for r in both)
    plan = spatial.spatial_context(p.select("district_id", F.col("pid").alias("building_id"), "rings", F.col("e").alias("edges"),
                                            F.lit(1.0).alias("cx"), F.lit(1.0).alias("cy")))._jdf.queryExecution().optimizedPlan()
    assert "ArrowEvalPython" in plan.toString()


def test_points_within_copies_a_point_to_few_tiles(spark, monkeypatch):
    """Every point was sent to nine tiles."""
    rng, sent, spread = np.random.default_rng(3), [], spatial.spread_hot_keys
    xy = np.round(rng.uniform(-200, 200, (300, 2)) / 5) * 5
    p = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "district_id int, i int, x double, y double")
    monkeypatch.setattr(spatial, "spread_hot_keys", lambda left, right, on, *rest: sent.append(right.count()) or spread(left, right, on, *rest))
    a, b = p.where("i < 150"), p.where("i >= 150")
    near = {r.i for r in spatial.points_within(a, b, 25.0).collect()}
    d2 = ((xy[:150, None] - xy[None, 150:]) ** 2).sum(2)
    assert near == set(np.flatnonzero((d2 <= 625).any(1)))
    assert 0 < sent[0] <= 4 * 150


def test_overlap_with_windows_that_overlap(spark):
    """Cells under several windows of a district count once; ranges of cells give what single cells give, and are fewer."""
    def table(boxes):
        df = spark.createDataFrame(boxes, "district_id int, unit int, x0 double, y0 double, x1 double, y1 double")
        return df.withColumn("rings", F.array(geo.ring_from(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))

    units = table([(0, 1, 0.0, 0.0, 40.0, 40.0), (0, 2, 41.5, 3.25, 77.0, 20.0), (1, 3, 0.0, 0.0, 9.0, 9.0), (2, 4, 5.0, 5.0, 6.0, 30.0)])
    windows = table([(0, 0, 10.0, 10.0, 30.0, 30.0), (0, 0, 20.0, 5.0, 60.0, 18.0), (0, 0, 22.0, 6.0, 24.0, 17.0), (2, 0, 0.0, 0.0, 50.0, 12.5)])
    got = {r.unit: (r.overlap_ratio, r.overlap_m2) for r in spatial.overlap_by_cells(units, windows, "unit", 1.0).collect()}
    cover = {(r.district_id, r.cell_x, r.cell_y) for r in spatial.cell_cover(windows, 1.0, ["district_id"]).collect()}
    own = spatial.cell_cover(units, 1.0, ["district_id", "unit"]).collect()
    for unit in (1, 2, 3, 4):
        cells = [(r.district_id, r.cell_x, r.cell_y) for r in own if r.unit == unit]
        met = sum(c in cover for c in cells)
        assert got[unit] == (met / len(cells), met * 1.0)
    assert spatial.cell_ranges(units, 1.0, ["district_id", "unit"]).count() < len(own) / 8
