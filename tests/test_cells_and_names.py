"""Outlines, densities and lines on cells, and names matched to districts, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from townloom.operators import outlines, raster, spatial


def cells_of(spark, sets):
    return spark.createDataFrame([(d, x, y) for d, cells in sets.items() for x, y in cells], "district_id int, cell_x long, cell_y long")


def test_outlines_are_closed_and_cover_the_cells(spark):
    rng = np.random.default_rng(4)
    sets = {0: {(x, y) for x in range(-3, 3) for y in range(4)},  # a block
            1: {(x, y) for x in range(5) for y in range(5) if (x, y) not in ((1, 1), (3, 3), (2, 2))},  # holes that touch at corners
            2: {(0, 0), (1, 1), (2, 0)}, 3: {tuple(p) for p in rng.integers(0, 14, (90, 2)).tolist()},
            4: {(x, 0) for x in range(400)}}
    rings = outlines.outline_rings(outlines.outline_corners(cells_of(spark, sets), 2.0)).collect()
    for d, cells in sets.items():
        mine = [r for r in rings if r.district_id == d]
        assert sum(r.area_m2 for r in mine) == 4 * len(cells) and [r.ring_no for r in sorted(mine, key=lambda r: r.ring_no)] == list(range(1, len(mine) + 1))
        for r in mine:
            p = [(c.x, c.y) for c in r.ring]
            assert p[0] == p[-1] and len(p) == r.corners + 1 and len(set(p[:-1])) <= len(p) - 1
            turns = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(p, p[1:])]
            assert all((u == 0) != (v == 0) for u, v in turns) and all((a[0] == 0) != (b[0] == 0) for a, b in zip(turns, turns[1:]))
    shape = lambda d: sorted((r.is_hole, r.corners, r.area_m2) for r in rings if r.district_id == d)
    # holes that meet at a corner are one void for cells joined by sides, hence one ring
    assert shape(0) == [(False, 4, 96.0)] and shape(2) == [(False, 4, 4.0)] * 3 and shape(4) == [(False, 4, 1600.0)]
    assert [s[0] for s in shape(1)] == [False, True]


@pytest.mark.parametrize("tile, block", [(64, 2048), (5, 3)])
def test_density_is_never_cut(spark, monkeypatch, tile, block):
    monkeypatch.setattr(raster, "KERNEL_TILE", tile)
    monkeypatch.setattr(raster, "KERNEL_POINTS", block)
    rng = np.random.default_rng(2)
    pts = {("a", 0): rng.uniform(0, 400, (30, 2)), ("a", 1): np.repeat([[20.0, 30.0]], 6, axis=0), ("b", 0): rng.uniform(0, 30, (4, 2))}
    df = spark.createDataFrame([(d, c, float(x), float(y)) for (c, d), ps in pts.items() for x, y in ps],
                               "district_id int, category string, x double, y double")
    ring = [[(50.0, 50.0), (350.0, 50.0), (350.0, 350.0), (50.0, 350.0), (50.0, 50.0)]]
    bounds = spark.createDataFrame([(0, ring), (1, ring)], "district_id int, rings array<array<struct<x:double,y:double>>>")
    canvas = spark.createDataFrame([(0, 0.0, 0.0, 399.0, 399.0), (1, 0.0, 0.0, 399.0, 399.0)],
                                   "district_id int, xmin double, ymin double, xmax double, ymax double")
    got = {(r.category, r.district_id, r.cell_x, r.cell_y): r.density
           for r in raster.kernel_density(df, bounds, canvas, 20.0, 9.0, category="category").collect()}
    want, centre = {}, (np.arange(20) + 0.5) * 20
    for (c, d), ps in pts.items():
        if len(ps) < 5:
            continue
        factor = lambda p: np.exp(-(centre[:, None] - p) ** 2 / (2 * 81.0))
        dens = (factor(ps[:, 0])[:, None] * factor(ps[:, 1])[None]).sum(-1)
        low = np.percentile(dens[dens > 0], 25)
        want |= {(c, d, i, j): dens[i, j] for i in range(20) for j in range(20)
                 if dens[i, j] >= low and dens[i, j] > 0 and 50 <= centre[i] < 350 and 50 <= centre[j] < 350}
    assert set(got) == set(want) and got == pytest.approx(want, rel=1e-9)
    assert min(want.values()) < np.exp(-8)  # beyond four bandwidths


def test_line_peaks_have_no_larger_neighbour(spark):
    # four separate bars: their long sides are the lines
    bars = {(x, y) for b in range(4) for x in range(60) for y in (b * 24, b * 24 + 1)}
    got = raster.line_alignment(cells_of(spark, {0: bars})).first()
    assert got.line_count == 4 and got.v_score == pytest.approx(1.0) and got.h_score < 1e-9
    assert raster.line_alignment(cells_of(spark, {0: bars}), peaks=3).first().line_count == 3


def test_names_of_districts(spark):
    dis = [(1, "01_Austin_River-Park-TX"), (2, "02_Dallas_River-Walk-TX"), (3, "03_Waco_Mill-TX"), (4, "04_New_York_Mill-Yard-NY")]
    dis += [(100 + i, f"{i}_Hotville_District-{'abcdefghij'[i % 10]}{i}-CA") for i in range(300)]  # a word that 300 districts share
    dis += [(900, "9_Twin-TX"), (901, "10_Twin-TX"), (902, "11_Ox-TX")]
    labels = [(1, "Austin River-Park", None), (2, "River", None), (3, "River", "Dallas"), (4, "Mill", "New York"), (5, "Waco", None),
              (6, "hotville", None), (7, "hotville", "Hotville"), (8, "The old Ox pub", None), (9, "ork", None), (10, "Twin", None),
              (11, None, None), (12, "", "Waco"), (13, "GreaterWacoMillArea", None), (14, "nowhere", "Austin")]
    got = spatial.match_by_name(spark.createDataFrame(labels, "label_id int, name string, town string").repartition(3),
                                spark.createDataFrame(dis, "district_id int, code string"), "name", "code", "town")
    assert {r.label_id: (r.district_id, r.matched_by, r.by_city) for r in got.collect()} == {
        1: (1, "exact", False), 3: (2, "token", True), 4: (4, "token", True), 5: (3, "token", False), 8: (902, "token", False),
        9: (4, "substring", False), 10: (900, "exact", False), 13: (3, "substring", False)}
