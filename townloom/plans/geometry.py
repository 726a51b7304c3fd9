"""Queries for geometry measures (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.operators import programs, spatial
from townloom.plans.catalog import query
from townloom.plans.fixtures import crosses, seg_d2


@query("g1_g2_footprint_measures", """
    SELECT building_id, area_m2, perimeter_m, sqrt(4 * area_m2 / pi()) AS equivalent_diameter_m,
      4 * pi() * area_m2 / (perimeter_m * perimeter_m + 1e-9) AS compactness,
      area_m2 / (w * h + 1e-9) AS solidity, greatest(w, h) / (least(w, h) + 1e-9) AS bbox_elongation
    FROM (SELECT building_id, 25 * a * b AS area_m2, 10 * (a + b) AS perimeter_m,
        greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3) AS w,
        greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) AS h FROM buildings0) b""",
       "area_m2 perimeter_m equivalent_diameter_m compactness solidity bbox_elongation")
def _(L):
    b = programs.add_shape_measures(L.buildings().select("building_id", "rings"))
    return b.drop("rings")


@query("g3_g6_hull_measures", """
    SELECT building_id, 1.0::double AS hull_ratio, 1.0::double AS roughness, 5 * greatest(a, b) AS mrr_long_side_m,
      5 * least(a, b) AS mrr_short_side_m, greatest(a, b) / least(a, b) AS mrr_elongation,
      sqrt(1 - pow(least(a, b) / greatest(a, b), 2)) AS eccentricity,
      5 * sqrt(a * a + b * b) AS max_diameter_m, 4 AS vertex_count,
      CASE WHEN a <> b THEN orientation_deg END AS orientation_deg
    FROM buildings0 JOIN (SELECT building_id, orientation_deg FROM buildings) USING (building_id)""",
       "hull_ratio roughness mrr_long_side_m mrr_short_side_m mrr_elongation eccentricity "
       "max_diameter_m orientation_deg")
def _(L):
    b = L.buildings().select("building_id", "rings", "area_m2", "perimeter_m")
    m = programs.add_hull_measures(b)
    square = F.abs(F.col("mrr_long_side_m") - F.col("mrr_short_side_m")) < 1e-6
    return m.select("building_id", "hull_ratio", "roughness", "mrr_long_side_m", "mrr_short_side_m",
                    "mrr_elongation", "eccentricity", "max_diameter_m", "vertex_count",
                    F.when(~square, F.pmod(F.round("orientation_deg", 6), F.lit(180.0)))
                    .alias("orientation_deg"))


@query("g7_hu_moments", """
    SELECT building_id, -log10((a * a + b * b) / (12 * a * b) + 1e-30) AS hu_1,
      CASE WHEN a <> b THEN -log10(pow((a * a - b * b) / (12 * a * b), 2) + 1e-30) END AS hu_2
    FROM buildings0""", "hu_1 hu_2")
def _(L):
    b = L.buildings().join(L.view("buildings0").select("building_id", "a", "b"), "building_id")
    hu = geo.hu_moments("rings")
    return b.select("building_id", hu[0].alias("hu_1"),
                    F.when(F.col("a") != F.col("b"), hu[1]).alias("hu_2"))


@query("g8_largest_part", """
    SELECT multi, part_no, area_m2 FROM (SELECT building_id // 3 AS multi, building_id % 3 AS part_no,
      area_m2, row_number() OVER (PARTITION BY building_id // 3 ORDER BY area_m2 DESC, building_id)
        AS r FROM buildings) q WHERE r = 1""", "area_m2")
def _(L):
    parts = L.buildings().select(F.expr("building_id div 3").alias("multi"),
                                 (F.col("building_id") % 3).alias("part_no"), "rings")
    return programs.largest_part(parts, ["multi"]).select("multi", "part_no",
                                                          geo.area("rings").alias("area_m2"))


@query("g9_simplified_rings", """
    SELECT building_id, CASE WHEN building_id % 2 = 0 THEN 4 ELSE 8 END AS vertices FROM buildings""")
def _(L):
    from townloom.functions.shapes import simplify_rings

    b = L.view("buildings0")
    bump = F.when(F.col("building_id") % 2 == 0, 0.1).otherwise(-2.0)
    corner = [("x0", "y0"), ("x1", "y1"), ("x2", "y2"), ("x3", "y3")]
    pts = []
    for i, (x, y) in enumerate(corner):
        nx, ny = corner[(i + 1) % 4]
        ex, ey = F.col(nx) - F.col(x), F.col(ny) - F.col(y)
        length = F.sqrt(ex * ex + ey * ey)
        pts += [(x, y), (F.col(x) + ex / 2 + ey / length * bump,
                         F.col(y) + ey / 2 - ex / length * bump)]
    ring = geo.ring_from(*pts, pts[0])
    return b.select("building_id", (F.size(simplify_rings(0.5)(ring)) - 1).alias("vertices"))


@query("g10_point_in_polygon", "SELECT place_id, zone FROM place_zone")
def _(L):
    return spatial.assign_zone(L.places(), L.boundaries()).select("place_id", "zone")


@query("g11_centroid_and_box", """
    SELECT building_id, cx, cy, (least(x0, x1, x2, x3) + greatest(x0, x1, x2, x3)) / 2 AS box_x,
      (least(y0, y1, y2, y3) + greatest(y0, y1, y2, y3)) / 2 AS box_y
    FROM buildings JOIN (SELECT building_id, x0, x1, x2, x3, y0, y1, y2, y3 FROM buildings0)
    USING (building_id)""", "cx cy box_x box_y")
def _(L):
    box = geo.bbox("rings")
    return L.buildings().select("building_id", "cx", "cy",
                                ((box["xmin"] + box["xmax"]) / 2).alias("box_x"),
                                ((box["ymin"] + box["ymax"]) / 2).alias("box_y"))


@query("g12_edge_distance", f"""
    SELECT p.place_id, sqrt(min({seg_d2('p.x', 'p.y')})) AS boundary_m
    FROM places p JOIN bnd e USING (district_id) GROUP BY 1""", "boundary_m")
def _(L):
    b = L.boundaries().select("district_id", "edges")
    return L.view("places").join(b, "district_id").select(
        "place_id", geo.distance_to_edges("edges", "x", "y").alias("boundary_m"))


@query("g12_arc_position", f"""
    SELECT place_id, min_by(before + t * len, (d2, i)) AS arc_m FROM (
      SELECT p.place_id, e.i, round({seg_d2('p.x', 'p.y')}, 6) AS d2,
        sqrt((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)) AS len,
        coalesce((SELECT sum(sqrt((q.x2 - q.x1) * (q.x2 - q.x1) + (q.y2 - q.y1) * (q.y2 - q.y1)))
           FROM bnd q WHERE q.district_id = e.district_id AND q.i < e.i), 0) AS before,
        least(greatest(((p.x - e.x1) * (e.x2 - e.x1) + (p.y - e.y1) * (e.y2 - e.y1)) /
         ((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)), 0), 1) AS t
      FROM places p JOIN bnd e USING (district_id)) q GROUP BY 1""", "arc_m")
def _(L):
    b = L.boundaries().select("district_id", F.col("rings")[0].alias("ring"))
    return L.view("places").join(b, "district_id").select(
        "place_id", geo.arc_position("ring", "x", "y").alias("arc_m"))


@query("g13_axis_projection", """
    SELECT place_id, (x - 500) * cos(radians(30.0)) + (y - 500) * sin(radians(30.0)) AS s,
      (y - 500) * cos(radians(30.0)) - (x - 500) * sin(radians(30.0)) AS perp FROM places""", "s perp")
def _(L):
    pos = geo.axis_position(F.lit(500.0), F.lit(500.0), F.lit(30.0), "x", "y")
    return L.view("places").select("place_id", pos["s"].alias("s"), pos["perp"].alias("perp"))


@query("g14_square_canvas", """
    SELECT district_id, half, 500 - half AS xmin, 500 + half AS xmax, pow(2 * half / 1000, 2) AS area_km2
    FROM (SELECT district_id, greatest(sqrt(least(greatest(radius / 100, 1), 12) * 1000000) / 2, radius)
      AS half FROM districts) d""", "half xmin xmax area_km2")
def _(L):
    box = geo.bbox("rings")
    b = L.boundaries().withColumn("c", geo.centroid("rings")).withColumn("half", geo.half_extent(
        box["xmin"], box["ymin"], box["xmax"], box["ymax"], F.col("radius") / 100))
    return b.select("district_id", "half", (F.col("c.x") - F.col("half")).alias("xmin"),
                    (F.col("c.x") + F.col("half")).alias("xmax"),
                    F.pow(F.col("half") * 2 / 1000, F.lit(2)).alias("area_km2"))


GRID_CELLS = """SELECT g.district_id, cx, cy, count(*) AS n FROM (
      SELECT district_id, cx, cy FROM districts, range(0, {n}) a(cx), range(0, {n}) b(cy)) g
    JOIN bnd e ON e.district_id = g.district_id AND {cross}
    GROUP BY ALL HAVING count(*) % 2 = 1"""


def boundary_cells(size: float) -> str:
    """SQL: cells of the district grid whose centre lies inside the boundary."""
    return GRID_CELLS.format(n=int(1000 / size), cross=crosses(f"((g.cx + 0.5) * {size})",
                                                               f"((g.cy + 0.5) * {size})"))


@query("g15_cell_cover", f"""
    SELECT district_id, count(*) AS cells, sum(cx * 100 + cy)::BIGINT AS mark
    FROM ({boundary_cells(20)}) c GROUP BY 1""")
def _(L):
    cells = spatial.cell_cover(L.boundaries(), 20.0, ["district_id"])
    return cells.groupBy("district_id").agg(F.count("*").alias("cells"), F.sum(
        F.col("cell_x") * 100 + F.col("cell_y")).alias("mark"))


REP_SQL = f"""
    SELECT building_id, district_id, (min(ix) + max(ix)) / 2 AS x, any_value(mid) AS y FROM (
      SELECT e.building_id, e.district_id, m.mid,
        (e.x2 - e.x1) * (m.mid - e.y1) / (e.y2 - e.y1) + e.x1 AS ix
      FROM bld_edges e JOIN (SELECT building_id, (least(y0, y1, y2, y3) + greatest(y0, y1, y2, y3)) / 2
        AS mid FROM buildings0) m USING (building_id)
      WHERE (e.y1 > m.mid) <> (e.y2 > m.mid)) q GROUP BY ALL"""


@query("g16_canvas_clip_and_cap", f"""
    SELECT building_id, total, total > 20000 AS truncated, r AS area_rank, r <= 20000 AS drawn FROM (
      SELECT building_id, district_id, count(*) OVER (PARTITION BY district_id) AS total,
        row_number() OVER (PARTITION BY district_id ORDER BY area_m2 DESC, building_id) AS r
      FROM (SELECT p.building_id, p.district_id, b.area_m2 FROM rep p JOIN buildings b USING (building_id)
        JOIN bnd e ON e.district_id = p.district_id AND {crosses('p.x', 'p.y')}
        GROUP BY ALL HAVING count(*) % 2 = 1) i) q""", extra={"rep": REP_SQL})
def _(L):
    b = L.buildings().withColumn("_p", spatial.representative_point("rings")).withColumn(
        "x", F.col("_p.x")).withColumn("y", F.col("_p.y"))
    inside = spatial.spatial_join(b.select("building_id", "district_id", "area_m2", "x", "y"),
                                  L.boundaries(), [], "left_semi")
    return programs.cap_largest(inside, "building_id").select("building_id", "total", "truncated", "area_rank", "drawn")


@query("g17_crop_to_boundary", f"""
    SELECT building_id FROM (
      SELECT v.building_id, v.k, count(*) % 2 = 1 AS inside FROM (
        SELECT building_id, district_id, i AS k, x1 AS x, y1 AS y FROM bld_edges) v
      JOIN bnd e ON e.district_id = v.district_id AND {crosses('v.x', 'v.y')} GROUP BY ALL) q
    WHERE inside GROUP BY 1
    UNION
    SELECT building_id FROM buildings0 WHERE least(x0, x1, x2, x3) <= 500 AND
      greatest(x0, x1, x2, x3) >= 500 AND least(y0, y1, y2, y3) <= 500
      AND greatest(y0, y1, y2, y3) >= 500""")
def _(L):
    return spatial.crop(L.buildings(), L.boundaries()).select("building_id")


@query("g18_lines_from_points", """
    SELECT feed_id, route_id, max_by(trip_id, (round(len, 4), -trip_id)) AS trip_id,
      max(round(len, 4)) AS length_m, CAST(max_by(n, (round(len, 4), -trip_id)) AS INTEGER) AS points
    FROM (SELECT feed_id, route_id, trip_id, coalesce(sum(d), 0) AS len, count(*) AS n FROM (
      SELECT feed_id, route_id, trip_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d
      FROM stop_times WINDOW w AS (PARTITION BY feed_id, trip_id ORDER BY seq)) s GROUP BY ALL) t
    GROUP BY ALL""", "length_m")
def _(L):
    from townloom.operators import transit

    lines = transit.lines_from_points(L.view("stop_times"), ["feed_id", "route_id", "trip_id"], "seq")
    best = transit.longest_line(lines, ["feed_id", "route_id"], "trip_id")
    return best.select("feed_id", "route_id", "trip_id", "length_m", F.size("line").alias("points"))


# Trips with an even number have a drawn shape; routes without any take the stops of their longest trip.
@query("g18_route_lines", """
    SELECT feed_id, route_id, max_by(trip_id, (drawn, round(len, 4), -trip_id)) AS ident,
      max_by(round(len, 4), (drawn, round(len, 4), -trip_id)) AS length_m,
      CASE WHEN max(drawn) = 1 THEN 'shape' ELSE 'stops' END AS basis
    FROM (SELECT feed_id, route_id, trip_id, (trip_id % 2 = 0)::INT AS drawn, coalesce(sum(d), 0) AS len FROM (
      SELECT feed_id, route_id, trip_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d
      FROM stop_times WINDOW w AS (PARTITION BY feed_id, trip_id ORDER BY seq)) s GROUP BY ALL) t
    GROUP BY ALL""", "length_m")
def _(L):
    from townloom.operators import transit

    lines = transit.lines_from_points(L.view("stop_times"), ["feed_id", "route_id", "trip_id"], "seq").withColumnRenamed("trip_id", "ident")
    return transit.route_lines(lines.where("ident % 2 = 0"), lines, ["feed_id", "route_id"]).drop("line")
