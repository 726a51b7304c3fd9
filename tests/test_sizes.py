"""Steps that are bounded per district, and what happens beyond the bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from townloom.operators import dedup, graph, neighbours, outlines, ranks, similarity
from townloom.plans import graphs
from townloom.plans.fixtures import Layers


def test_districts_of_any_size(spark):
    """Districts followed by one task and districts that go by joins give the same rows; both may be in one table."""
    rng = np.random.default_rng(21)
    rows = [(d, int(a), int(b), float(w)) for d, n in ((0, 30), (1, 9)) for a, b, w in zip(
        rng.integers(0, n // 2, n), rng.integers(0, n // 2, n), rng.integers(1, 4, n)) if a != b]
    e = spark.createDataFrame(rows, "district_id int, src long, dst long, length_m double")
    first = e.groupBy("district_id").agg(F.min("src").alias("node"))
    nodes = graph.both_ways(e, ["district_id"]).select("district_id", F.col("src").alias("node")).distinct()
    one, two = ((sorted(map(tuple, graph.connected_components(nodes, e, limit=limit).collect())),
                 sorted(map(tuple, graph.shortest_paths(e, first, 5.0, limit=limit).collect())),
                 {tuple(r)[:4]: r.centrality for r in graph.edge_betweenness(e, limit=limit).collect()}) for limit in (15, 10_000))
    assert one[:2] == two[:2] and {r[0] for r in one[0]} == {0, 1}
    assert one[2] == pytest.approx(two[2])
    text = lambda t, *cs: t.withColumns({c: F.format_string("n%03d", c) for c in cs})
    named = graph.connected_components(text(nodes, "node"), text(e, "src", "dst"))
    assert sorted((r.district_id, int(r.node[1:]), int(r.component[1:])) for r in named.collect()) == one[0]



def test_street_filters_read_columns(spark):
    """Filters of nested cases were pushed below the layer, each case many times over."""
    plan = graphs.walkable(Layers(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE") < 40


def test_outlines_of_any_size(spark):
    rng = np.random.default_rng(4)
    cells = [(d, int(x), int(y)) for d, n in ((0, 300), (1, 20), (2, 1)) for x, y in set(map(tuple, rng.integers(-9, 9, (n, 2))))]
    df = spark.createDataFrame(cells, "district_id int, cell_x long, cell_y long")
    one, two = (sorted(map(tuple, outlines.outline_corners(df, 2.0, limit=limit).collect())) for limit in (15, 10_000))
    assert one == two and {r[0] for r in one} == {0, 1, 2}


def test_focus_pairs_are_not_shuffled(spark):
    """Pairs went through a group-by; only rows and focus rows are to be sent."""
    vec = lambda r: np.array([v or 0.0 for v in r])
    data = {0: (1.0, 2.0), 1: (None, 3.0), 2: (0.0, 0.0), 3: (4.0, None), 4: (None, None), 5: (-2.0, 1.0)}
    df = spark.createDataFrame([(i, *v) for i, v in data.items()], "id long, a double, b double")
    out = similarity.distances_to(df, df.where("id in (0, 1)"), "id", ["a", "b"])
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.focus, r.id): r.distance for r in out.collect()}
    assert len(got) == 2 * len(data)
    for (f, i), d in got.items():
        x, y = vec(data[f]), vec(data[i])
        length = np.sqrt((x @ x) * (y @ y))
        assert d == pytest.approx(1 - (x @ y / length if length else 0.0))


def test_filters_do_not_repeat_geometry(spark):
    """The filter that chooses splitters held the outline's formula many times, in the one task of a small scan."""
    layers = Layers(spark, "/root/testdata/sf0.001")
    raw = layers.view("buildings0").withColumn("area_m2", F.col("a") * F.col("b") * 25)
    for buildings in (layers.buildings(), raw):
        df = ranks.median_member(buildings, ["district_id", "cluster_id"], "building_id", "area_m2")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.split("\n") if "Filter" in line]
        assert filters and all("aggregate(" not in f and "p_size" not in f for f in filters)


def test_neighbour_search_sends_on_what_can_count(spark):
    """Every pair of blocks sent on its k best of each query, whatever the query had found before."""
    rows = [(1, [1], [0.0, 0.0], [1.0], [2, 3], [1.0, 0.0, 0.0, 2.0]), (1, [1], [0.0, 0.0], [1.0], [4, 5], [0.5, 0.0, 1.0, 0.0])]
    pairs = spark.createDataFrame(rows, "cell long, q_ids array<long>, q_flat array<double>, q_most array<double>, "
                                        "c_ids array<long>, c_flat array<double>").coalesce(1)
    got = neighbours.solved(pairs, 2, "bigint", "euclidean", False, 6).collect()
    assert sorted((r.id, r.neighbor, r.distance) for r in got) == [(1, 2, 1.0), (1, 4, 0.5)]


def test_districts_go_on_over_arrow_batches(spark):
    """A district whose rows arrive in several batches is followed once, as a whole; neighbours stay apart."""
    rows = spark.range(400).select((F.col("id") % 7).alias("district_id"), F.col("id").alias("node"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = graph.followed(rows, ["district_id"], lambda of: {"low": of["node"].min(keepdims=True), "n": np.array([float(len(of["node"]))])},
                             low="node", n="double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((r.district_id, r.low, r.n) for r in got) == [(d, d, float(len(range(d, 400, 7)))) for d in range(7)]


def test_tiles_of_any_order_type_in_small_batches(spark):
    """Points kept do not depend on the type of the order, nor on how many rows an Arrow batch holds; tiles go in batches."""
    rng = np.random.default_rng(8)
    pts = [(f"d{i % 2}", i, "a" if i % 3 else "b", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 90, (120, 2)))]
    df = spark.createDataFrame(pts, "district_id string, pid int, name string, x double, y double")
    kept = {r.pid for r in dedup.greedy_dedup(df, "pid", "name", 20.0).collect()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        later = dedup.greedy_dedup(df.withColumn("at", F.timestamp_seconds("pid")), "at", "name", 20.0, tile_points=30)
        assert {r.pid for r in later.collect()} == kept and len(kept) < 120
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    tiled = df.withColumnsRenamed({"name": "_name", "pid": "_id"}).withColumns({c: F.lit(0) for c in ("_cx", "_cy", "_tx", "_ty")})
    plan = dedup._followed(tiled, tiled, ["district_id", "_name"], 100.0, 20.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan
