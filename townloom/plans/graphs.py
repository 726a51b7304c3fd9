"""Queries for graphs (R, A42)."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.operators import graph, outlines
from townloom.plans.catalog import query
from townloom.plans.joins import GAPS
from townloom.session import cut

INLIST = lambda vs: "(" + ", ".join(f"'{v}'" for v in vs) + ")"


def walkable(L):
    s = L.view("streets").where(F.col("highway").isin(V.WALKABLE_CLASSES))
    return s.select("district_id", F.col("u").alias("src"), F.col("v").alias("dst"), "length_m")


WALK = f"SELECT DISTINCT district_id, lo, hi FROM streets WHERE highway IN {INLIST(V.WALKABLE_CLASSES)}"


@query("r1_components", """
    SELECT district_id, sum(n)::BIGINT AS nodes, count(*) AS components, max(n) AS largest_component_nodes,
      count(*) FILTER (WHERE n <= 2) AS orphan_components FROM (
      SELECT district_id, root, count(*) AS n FROM (SELECT district_id, node, min(root) AS root FROM reach
        GROUP BY ALL) c GROUP BY ALL) q GROUP BY 1""", extra={
    "walk": WALK,
    "links": "SELECT district_id, lo AS a, hi AS b FROM walk UNION SELECT district_id, hi, lo FROM walk",
    "reach": """SELECT DISTINCT district_id, a AS root, a AS node FROM links UNION
        SELECT r.district_id, r.root, l.b FROM reach r JOIN links l ON l.district_id = r.district_id
        AND l.a = r.node"""})
def _(L):
    e = walkable(L)
    nodes = graph.both_ways(e, ["district_id"]).select("district_id", F.col("src").alias("node"))
    return graph.component_summary(graph.connected_components(nodes, e))


@query("r2_street_graph", """
    SELECT district_id, src, dst, count(*) AS parallel, min(length_m) AS shortest FROM (
      SELECT district_id, length_m, CAST(round_even(x1 / 50, 0) AS BIGINT) || '_'
        || CAST(round_even(y1 / 50, 0) AS BIGINT) AS src, CAST(round_even(x2 / 50, 0) AS BIGINT) || '_'
        || CAST(round_even(y2 / 50, 0) AS BIGINT) AS dst FROM streets) q WHERE src <> dst GROUP BY ALL""",
       "shortest")
def _(L):
    s = L.view("streets").withColumn("edge_id", F.lit(0))
    return graph.street_graph(s, 50.0).groupBy("district_id", "src", "dst").agg(
        F.count("*").alias("parallel"), F.min("length_m").alias("shortest"))


@query("r3_walk_graph", f"""
    SELECT district_id, count(*) AS edges, sum(w) AS total_m FROM (SELECT DISTINCT district_id,
      least(x1, x2) AS a, least(y1, y2) AS b, greatest(x1, x2) AS c, greatest(y1, y2) AS d,
      sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS w FROM streets
      WHERE highway IN {INLIST(V.WALKABLE_CLASSES)}) q GROUP BY 1""", "total_m")
def _(L):
    s = L.view("streets").where(F.col("highway").isin(V.WALKABLE_CLASSES)).withColumn(
        "line", geo.ring_from(("x1", "y1"), ("x2", "y2")))
    return graph.walk_graph(s).groupBy("district_id").agg(
        F.count("*").alias("edges"), F.sum("length_m").alias("total_m"))


# Paths of the streets that cars may use: shortest simple edges of the largest component of a district,
# distances by relaxation, paths counted by listing them. An edge's flow sums, over ordered pairs, the share
# of their shortest paths that use it.
PATHS = {
    "cars": f"""SELECT district_id, lo, hi, min(length_m) AS len FROM streets
      WHERE highway IN {INLIST(V.VEHICULAR_CLASSES)} GROUP BY ALL""",
    "ways": "SELECT district_id, lo AS a, hi AS b, len FROM cars UNION SELECT district_id, hi, lo, len FROM cars",
    "met": """SELECT DISTINCT district_id, a AS root, a AS node FROM ways UNION
      SELECT m.district_id, m.root, w.b FROM met m JOIN ways w ON w.district_id = m.district_id AND w.a = m.node""",
    "part": "SELECT district_id, node, min(root) AS comp FROM met GROUP BY ALL",
    "main": """SELECT district_id, arg_min(comp, (-n, comp)) AS comp, max(n) AS n FROM (
      SELECT district_id, comp, count(*) AS n FROM part GROUP BY ALL) q GROUP BY 1""",
    "mway": """SELECT w.*, m.n FROM ways w JOIN part p ON p.district_id = w.district_id AND p.node = w.a
      JOIN main m ON m.district_id = p.district_id AND m.comp = p.comp""",
    "far": """SELECT * FROM (WITH RECURSIVE t(district_id, s, v, d) USING KEY (district_id, s, v) AS (
        SELECT DISTINCT district_id, a, a, 0.0::double FROM mway UNION
        SELECT x.district_id, x.s, x.v, min(x.d) FROM (SELECT t.district_id, t.s, w.b AS v, t.d + w.len AS d
          FROM t JOIN mway w ON w.district_id = t.district_id AND w.a = t.v) x
        LEFT JOIN recurring.t r ON r.district_id = x.district_id AND r.s = x.s AND r.v = x.v
        WHERE r.d IS NULL OR x.d < r.d GROUP BY ALL) SELECT * FROM t) q""",
    "arc": """SELECT x.district_id, x.s, x.v AS a, y.v AS b, y.d FROM far x JOIN mway w ON w.district_id = x.district_id
      AND w.a = x.v JOIN far y ON y.district_id = x.district_id AND y.s = x.s AND y.v = w.b
      AND abs(x.d + w.len - y.d) <= 1e-9""",
    "walked": """SELECT district_id, s, s AS v FROM far WHERE s = v UNION ALL
      SELECT k.district_id, k.s, r.b FROM walked k JOIN arc r ON r.district_id = k.district_id AND r.s = k.s AND r.a = k.v""",
    "ways_to": "SELECT district_id, s, v, count(*)::double AS p FROM walked GROUP BY ALL",
    "pair": """SELECT f.district_id, f.s, f.v, f.d, k.p FROM far f JOIN ways_to k
      ON k.district_id = f.district_id AND k.s = f.s AND k.v = f.v""",
    "flow": """SELECT r.district_id, least(r.a, r.b) AS src, greatest(r.a, r.b) AS dst,
        sum(x.p * y.p / z.p) / (max(m.n) * (max(m.n) - 1))::double AS centrality
      FROM arc r JOIN pair x ON x.district_id = r.district_id AND x.s = r.s AND x.v = r.a
      JOIN pair y ON y.district_id = r.district_id AND y.s = r.b
      JOIN pair z ON z.district_id = r.district_id AND z.s = r.s AND z.v = y.v
      JOIN main m ON m.district_id = r.district_id WHERE abs(r.d + y.d - z.d) <= 1e-9 GROUP BY ALL"""}


def centrality(L):
    s = L.view("streets").where(F.col("highway").isin(V.VEHICULAR_CLASSES)).select(
        "district_id", F.struct("lo", "hi", "length_m").alias("edge_id"),
        F.col("u").alias("src"), F.col("v").alias("dst"), "length_m")
    return s, graph.edge_betweenness(s)


@query("r4_edge_betweenness", """
    SELECT m.district_id, m.a AS src, m.b AS dst, m.len AS length_m, coalesce(f.centrality, 0.0) AS centrality
    FROM mway m LEFT JOIN flow f ON f.district_id = m.district_id AND f.src = m.a AND f.dst = m.b WHERE m.a < m.b""",
       "length_m centrality", extra=PATHS)
def _(L):
    return centrality(L)[1]


CENTRAL = {**PATHS, "one": f"""
    SELECT district_id, lo, hi, length_m, lo || '-' || hi || '-' || length_m AS edge FROM streets
      WHERE highway IN {INLIST(V.VEHICULAR_CLASSES)}""", "shortest": """
    SELECT o.district_id, o.lo, o.hi, count(*) FILTER (WHERE o.length_m = c.len) AS n FROM one o JOIN cars c
      ON c.district_id = o.district_id AND c.lo = o.lo AND c.hi = o.hi GROUP BY ALL""", "central": """
    SELECT district_id, count(*) AS feature_count, max(c) AS max_centrality, avg(c) AS mean_centrality,
      avg(c) FILTER (WHERE c > 0) AS mean_centrality_nonzero FROM (
      SELECT s.district_id, s.edge, avg(CASE WHEN s.length_m = c.len AND f.centrality IS NOT NULL
        THEN f.centrality / n.n ELSE 0 END) AS c FROM one s
      JOIN cars c ON c.district_id = s.district_id AND c.lo = s.lo AND c.hi = s.hi
      LEFT JOIN flow f ON f.district_id = s.district_id AND f.src = s.lo AND f.dst = s.hi
      JOIN shortest n ON n.district_id = s.district_id AND n.lo = s.lo AND n.hi = s.hi GROUP BY ALL) q GROUP BY 1"""}


def street_centrality(L):
    s, c = centrality(L)
    return graph.centrality_summary(graph.attach_centrality(s, c))


@query("a42_centrality_summary", "SELECT * FROM central", "max_centrality mean_centrality mean_centrality_nonzero", extra=CENTRAL)
def _(L):
    return street_centrality(L)


def walk_reach(L):
    """Walking distances from the node nearest to the district centre, up to 15 minutes."""
    per_min = V.WALK_SPEED_MPH * 5280 * V.M_PER_FT / 60
    s = L.view("streets").where(F.col("highway").isin(V.WALKABLE_CLASSES))
    # the shortest of parallel streets, from one scan
    s = cut(s.groupBy("district_id", "u", "v", "x1", "y1", "x2", "y2").agg(F.min("length_m").alias("length_m")))
    nodes = s.select("district_id", F.col("u").alias("node"), F.col("x1").alias("x"),
                     F.col("y1").alias("y")).union(s.select("district_id", "v", "x2", "y2")).distinct()
    centre = L.view("districts").select("district_id", F.lit(500.0).alias("x"), F.lit(500.0).alias("y"))
    start = graph.nearest_node(nodes, centre)
    edges = s.select("district_id", F.col("u").alias("src"), F.col("v").alias("dst"), "length_m")
    return graph.shortest_paths(edges, start, per_min * 15), nodes, per_min


@query("r5_nearest_node", f"""
    SELECT district_id, arg_min(node, (d, node)) AS node, min(d) AS snap_m FROM (
      SELECT district_id, node, round(sqrt(pow(x - 500, 2) + pow(y - 500, 2)), 6) AS d FROM (
        SELECT district_id, u AS node, x1 AS x, y1 AS y FROM streets WHERE highway IN {INLIST(V.WALKABLE_CLASSES)}
        UNION SELECT district_id, v, x2, y2 FROM streets WHERE highway IN {INLIST(V.WALKABLE_CLASSES)}) n) q
    GROUP BY 1""", "snap_m")
def _(L):
    s = L.view("streets").where(F.col("highway").isin(V.WALKABLE_CLASSES))
    nodes = s.select("district_id", F.col("u").alias("node"), F.col("x1").alias("x"),
                     F.col("y1").alias("y")).union(s.select("district_id", "v", "x2", "y2")).distinct()
    centre = L.view("districts").select("district_id", F.lit(500.0).alias("x"), F.lit(500.0).alias("y"))
    return graph.nearest_node(nodes, centre)


NEAR = f"""
    SELECT district_id, arg_min(node, (d, node)) AS node FROM (
      SELECT district_id, node, round(sqrt(pow(x - 500, 2) + pow(y - 500, 2)), 6) AS d FROM spots) q GROUP BY 1"""
WALKED = {
    "spots": f"""SELECT district_id, u AS node, x1 AS x, y1 AS y FROM streets WHERE highway IN {INLIST(V.WALKABLE_CLASSES)}
      UNION SELECT district_id, v, x2, y2 FROM streets WHERE highway IN {INLIST(V.WALKABLE_CLASSES)}""",
    "first": NEAR,
    "paces": f"""SELECT district_id, a, b, min(length_m) AS len FROM (
      SELECT district_id, lo AS a, hi AS b, length_m FROM streets WHERE highway IN {INLIST(V.WALKABLE_CLASSES)} UNION ALL
      SELECT district_id, hi, lo, length_m FROM streets WHERE highway IN {INLIST(V.WALKABLE_CLASSES)}) q GROUP BY ALL""",
    "reached": f"""SELECT * FROM (WITH RECURSIVE t(district_id, v, d) USING KEY (district_id, v) AS (
        SELECT district_id, node, 0.0::double FROM first UNION
        SELECT x.district_id, x.v, min(x.d) FROM (SELECT t.district_id, w.b AS v, t.d + w.len AS d
          FROM t JOIN paces w ON w.district_id = t.district_id AND w.a = t.v) x
        LEFT JOIN recurring.t r ON r.district_id = x.district_id AND r.v = x.v
        WHERE x.d <= {V.WALK_SPEED_MPH * 5280 * V.M_PER_FT / 60 * 15!r} AND (r.d IS NULL OR x.d < r.d) GROUP BY ALL) SELECT * FROM t) q"""}


@query("r5_walk_budgets", f"""
    SELECT district_id, minutes, minutes * {V.WALK_SPEED_MPH * 5280 * V.M_PER_FT / 60!r} AS budget_m, count(*) AS reachable_nodes
    FROM reached, (SELECT unnest({list(V.WALK_MINUTES)}) AS minutes) m
    WHERE d <= minutes * {V.WALK_SPEED_MPH * 5280 * V.M_PER_FT / 60!r} GROUP BY ALL""", "budget_m", extra=WALKED)
def _(L):
    reached, _, per_min = walk_reach(L)
    return graph.walk_budgets(reached, V.WALK_MINUTES, per_min)


WALK_CELLS = {**WALKED, "shed": """
    SELECT DISTINCT r.district_id, CAST(floor(p.x / 20) AS BIGINT) + i AS cx, CAST(floor(p.y / 20) AS BIGINT) + j AS cy
    FROM reached r JOIN spots p ON p.district_id = r.district_id AND p.node = r.v, range(-4, 5) a(i), range(-4, 5) b(j)
    WHERE pow((floor(p.x / 20) + i + 0.5) * 20 - p.x, 2) + pow((floor(p.y / 20) + j + 0.5) * 20 - p.y, 2) <= 3600"""}


def walkshed(L):
    reached, nodes, _ = walk_reach(L)
    return graph.isochrone_area(reached.join(nodes, ["district_id", "node"]))


@query("r6_walkshed_area", "SELECT district_id, count(*) * 400.0 AS area_m2 FROM shed GROUP BY 1", "area_m2", extra=WALK_CELLS)
def _(L):
    return walkshed(L)


# Rings less holes by counting cells, shared sides and full blocks of four; corners by the cells around each point.
@query("r6_walkshed_outline", """
    SELECT c.district_id, c.n - coalesce(s.n, 0) + coalesce(q.n, 0) AS rings_less_holes, c.n * 400.0 AS area_m2,
      (4 * c.n - 2 * coalesce(s.n, 0)) * 20.0 AS perimeter_m, k.corners
    FROM (SELECT district_id, count(*) AS n FROM shed GROUP BY 1) c
    LEFT JOIN (SELECT a.district_id, count(*) AS n FROM shed a JOIN shed b ON a.district_id = b.district_id
      AND ((b.cx = a.cx + 1 AND b.cy = a.cy) OR (b.cx = a.cx AND b.cy = a.cy + 1)) GROUP BY 1) s USING (district_id)
    LEFT JOIN (SELECT district_id, count(*) FILTER (WHERE n = 4) AS n FROM around GROUP BY 1) q USING (district_id)
    LEFT JOIN (SELECT district_id, CAST(sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND spread = 0 THEN 2 ELSE 0 END) AS BIGINT)
      AS corners FROM around GROUP BY 1) k USING (district_id)""", "area_m2 perimeter_m", extra={**WALK_CELLS, "around": """
    SELECT district_id, px, py, count(*) AS n, abs(sum(CASE WHEN i = j THEN 1 ELSE -1 END)) - 2 AS spread FROM (
      SELECT district_id, cx + i AS px, cy + j AS py, i, j FROM shed, range(0, 2) a(i), range(0, 2) b(j)) p GROUP BY ALL"""})
def _(L):
    reached, nodes, _ = walk_reach(L)
    rings = outlines.isochrone_outline(reached.join(nodes, ["district_id", "node"]))
    return rings.groupBy("district_id").agg(
        F.sum(F.when(F.col("is_hole"), -1).otherwise(1)).alias("rings_less_holes"), F.sum("area_m2").alias("area_m2"),
        F.sum("perimeter_m").alias("perimeter_m"), F.sum("corners").alias("corners"))


ADJ = """SELECT c.building_id AS src, c.other AS dst, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))
      AS centroid_m, g.gap AS gap_m, a.district_id FROM cand c JOIN buildings a ON a.building_id = c.building_id
    JOIN buildings b ON b.building_id = c.other JOIN gaps g ON g.building_id = c.building_id AND g.other = c.other
    WHERE sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 80"""


@query("r7_adjacency_radius", "SELECT district_id, src, dst, centroid_m, gap_m FROM adj", "centroid_m gap_m",
       extra={**GAPS, "adj": ADJ})
def _(L):
    return graph.adjacency_edges(L.buildings())


@query("r7_adjacency_nearest", """
    SELECT DISTINCT district_id, src, dst FROM (SELECT district_id, a AS src, b AS dst FROM near UNION ALL
      SELECT district_id, b, a FROM near) q""", extra={"near": """
    SELECT district_id, a, b FROM (SELECT x.district_id, x.building_id AS a, y.building_id AS b, row_number() OVER (
      PARTITION BY x.building_id ORDER BY round(sqrt(pow(x.cx - y.cx, 2) + pow(x.cy - y.cy, 2)), 6), y.building_id)
      AS r FROM buildings x JOIN buildings y ON x.district_id = y.district_id AND x.building_id <> y.building_id
      AND pow(x.cx - y.cx, 2) + pow(x.cy - y.cy, 2) <= 14400) q WHERE r <= 6"""})
def _(L):
    return graph.adjacency_edges(L.buildings(), "knn", prune=120.0).select("district_id", "src", "dst")


@query("r9_tile_subgraphs", """
    SELECT district_id, tile, count(*) AS edges FROM (SELECT e.district_id, a.tile FROM adj e
      JOIN tiles a ON a.building_id = e.src JOIN tiles b ON b.building_id = e.dst AND a.tile = b.tile
      WHERE a.n >= 3) q GROUP BY ALL""", extra={**GAPS, "adj": ADJ, "tiles": """
    SELECT building_id, district_id, tile, count(*) OVER (PARTITION BY district_id, tile) AS n FROM (
      SELECT building_id, district_id, CAST(floor((cx - min(cx) OVER w) / 300) AS BIGINT) || '_'
        || CAST(floor((cy - min(cy) OVER w) / 300) AS BIGINT) AS tile FROM buildings
      WINDOW w AS (PARTITION BY district_id)) t"""})
def _(L):
    b = L.buildings()
    t = graph.assign_tiles(b, 300.0)
    return graph.induced_subgraphs(t, graph.adjacency_edges(b), "building_id", 3).groupBy(
        "district_id", "tile").agg(F.count("*").alias("edges"))


@query("r10_graph_diagnostics", """
    SELECT district_id, count(*) AS nodes, sum(deg)::BIGINT AS edges, avg(deg) AS mean_degree,
      count(*) FILTER (WHERE deg = 0) AS isolated, median(deg)::double AS median_degree FROM (
      SELECT b.district_id, b.building_id, count(e.src) AS deg FROM buildings b LEFT JOIN adj e
        ON e.src = b.building_id GROUP BY ALL) q GROUP BY 1""", "mean_degree median_degree",
       extra={**GAPS, "adj": ADJ})
def _(L):
    b = L.buildings()
    return graph.graph_diagnostics(b, graph.adjacency_edges(b), "building_id")
