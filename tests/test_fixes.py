"""Cases that once gave wrong or cut results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from townloom.functions.shapes import clipped_area, simple_overlap
from townloom.operators import programs, raster, similarity
from townloom.plans import catalog
from townloom.session import scratch_path
from townloom.sources import readers
from townloom.streaming import intake

catalog.load_all()


def test_cosine_of_zero_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [3.0, 0.0]), (5, [0.0, 0.0])],
                               "id bigint, vec array<double>")
    for pivots in (None, 2):
        got = {(r.id, r.neighbor): r.distance for r in similarity.nearest(df, 9, "id", "vec", "cosine", pivots=pivots).collect()}
        assert len(got) == 20 and got[2, 4] == 0
        assert all(d == 1 for p, d in got.items() if p not in ((2, 4), (4, 2)))


def test_feeds_with_their_own_headers(spark):
    path = scratch_path(spark, "feeds")
    a = spark.createDataFrame([("9", "S9")], "trip_id string, stop_id string")
    b = spark.createDataFrame([("S7", "7", "x")], "stop_id string, trip_id string, note string")
    for feed, df in ((1, a), (2, b)):
        df.coalesce(1).write.option("header", True).csv(f"{path}/stop_times/feed_id={feed}")
    got = {(r.feed_id, r.trip_id, r.stop_id, r.note) for r in readers.read_gtfs(spark, path, "stop_times").collect()}
    assert got == {("1", "9", "S9", None), ("2", "7", "S7", "x")}


def test_window_that_is_not_convex():
    window = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)  # a notch from above
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    x, y = window[:, 0], window[:, 1]
    area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
    assert np.isclose(simple_overlap(square, window), area)
    top = np.array([(0, 2), (4, 2), (4, 4), (0, 4)], float)
    below = np.array([(0, 0), (4, 0), (4, 2), (0, 2)], float)
    assert np.isclose(simple_overlap(top, window) + simple_overlap(below, window), area)
    assert np.isclose(simple_overlap(top, square), clipped_area(top, square))


def test_unbuilt_roads_cover_nothing(spark):
    road = spark.createDataFrame([(1, "razed", 0.0, 0.0, 50.0, 0.0, 6.0), (1, "primary", 0.0, 100.0, 50.0, 100.0, 6.0)],
                                 "district_id int, highway string, x1 double, y1 double, x2 double, y2 double, half_width double")
    cells = raster.layer_cells({"roads": road}, 10.0).collect()
    assert cells and all(c.cell_y > 5 for c in cells)


def test_canvas_keeps_every_footprint(spark):
    df = spark.range(10).select(F.lit(1).alias("district_id"), F.col("id").alias("building_id"), F.col("id").cast("double").alias("area_m2"))
    got = programs.cap_largest(df, "building_id", cap=3)
    assert got.count() == 10 and got.where("drawn").count() == 3 and got.where("not truncated").count() == 0


def test_intake_restart_repeats_nothing(spark):
    source, target, state = (scratch_path(spark, n) for n in ("source", "target", "state"))
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "district_id int, v string")
    rows.write.parquet(source)
    count = lambda b: b.groupBy("district_id").agg(F.count("*").alias("n"))
    for _ in range(2):
        intake.run_intake(spark, source, rows.schema, "*.parquet", count, target, state)
    assert intake.merged_counts(spark, target, ["district_id"], "n").first().n == 2
    with pytest.raises(TypeError):
        intake.run_intake(spark, source, rows.schema, "*.parquet", count, target)


@pytest.mark.parametrize("name", ["a3_building_programs", "a29_plan_footprint", "j4_largest_overlap"])
def test_polygons_are_not_broadcast(spark, name):
    """The optimizer takes the cells of all footprints for a table as small as the file they come from."""
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 0
