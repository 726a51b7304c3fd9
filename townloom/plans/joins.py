"""Queries for spatial and lookup joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.operators import spatial
from townloom.plans.catalog import query
from townloom.plans.fixtures import crosses, pick
from townloom.plans.geometry import REP_SQL, boundary_cells


@query("j1_places_in_buildings", """
    SELECT p.place_id, b.building_id FROM places_p p
    LEFT JOIN (SELECT place_id, building_id FROM place_bld WHERE inside) b USING (place_id)""")
def _(L):
    return spatial.spatial_join(L.places(), L.buildings(), ["building_id"], "left").select(
        "place_id", "building_id")


@query("j2_places_adjacent_to_buildings", """
    SELECT place_id, building_id, dist FROM place_bld WHERE dist <= 10""", "dist")
def _(L):
    return spatial.spatial_join(L.places(), L.buildings(), ["building_id"], within=10.0,
                                distance_as="dist").select("place_id", "building_id", "dist")


@query("j3_nearest_building", """
    SELECT place_id, building_id, dist AS distance_m FROM (SELECT *, rank() OVER (
      PARTITION BY place_id ORDER BY round(dist, 6)) AS r FROM place_bld WHERE dist <= 25) q
    WHERE r = 1""", "distance_m")
def _(L):
    return spatial.nearest_polygon(L.places().select("place_id", "district_id", "x", "y"),
                                   L.buildings(), "place_id", "building_id").select(
        "place_id", "building_id", "distance_m")


BLD_CELLS = """
    SELECT c.building_id, c.district_id, c.cx, c.cy FROM (
      SELECT building_id, district_id, cx, unnest(range(ylo, yhi + 1)) AS cy FROM (
        SELECT building_id, district_id, unnest(range(
            floor((least(x0, x1, x2, x3) + {dx}) / {s})::BIGINT,
            floor((greatest(x0, x1, x2, x3) + {dx}) / {s})::BIGINT + 1)) AS cx,
          floor((least(y0, y1, y2, y3) + {dy}) / {s})::BIGINT AS ylo,
          floor((greatest(y0, y1, y2, y3) + {dy}) / {s})::BIGINT AS yhi FROM buildings0) q) c
    JOIN (SELECT building_id, x1 + {dx} AS x1, y1 + {dy} AS y1, x2 + {dx} AS x2, y2 + {dy} AS y2
          FROM bld_edges) e ON e.building_id = c.building_id
      AND """ + crosses("((c.cx + 0.5) * {s})", "((c.cy + 0.5) * {s})") + """
    GROUP BY ALL HAVING count(*) % 2 = 1"""


def building_cells(size: float, dx: float = 0, dy: float = 0) -> str:
    return BLD_CELLS.format(s=size, dx=dx, dy=dy)


def moved(df, dx: float, dy: float):
    """Polygons shifted by a vector."""
    ring = lambda r: F.transform(r, lambda p: F.struct((p["x"] + dx).alias("x"),
                                                       (p["y"] + dy).alias("y")))
    return df.withColumn("rings", F.transform("rings", ring))


@query("j4_largest_overlap", """
    SELECT building_id, source_id, cells * 16.0::double AS overlap_m2 FROM (
      SELECT a.building_id, b.building_id AS source_id, count(*) AS cells, row_number() OVER (
        PARTITION BY a.building_id ORDER BY count(*) DESC, b.building_id) AS r
      FROM cells_a a JOIN cells_b b USING (district_id, cx, cy) GROUP BY 1, 2) q WHERE r = 1""",
       "overlap_m2", extra={"cells_a": building_cells(4), "cells_b": building_cells(4, 6, 3)})
def _(L):
    b = L.buildings().select("district_id", "building_id", "rings")
    other = moved(b, 6, 3).withColumnRenamed("building_id", "source_id")
    return spatial.largest_overlap(b, other, "building_id", "source_id", 4.0).select(
        "building_id", "source_id", "overlap_m2")


@query("j5_centroid_transfer", """
    SELECT building_id, u.unit_id, u.total_pop FROM buildings b LEFT JOIN units u
      ON u.district_id = b.district_id AND u.ux <= cx AND cx < u.ux + 250 AND u.uy <= cy
      AND cy < u.uy + 250""", "total_pop")
def _(L):
    return spatial.transfer_first(L.buildings(), L.units(), "building_id", "unit_id",
                                  ["total_pop"]).select("building_id", "unit_id", "total_pop")


UNIT_CELLS = f"""SELECT u.district_id, u.unit_id, count(c.cx) * 100.0::double AS overlap_m2,
      count(c.cx) / 625.0::double AS overlap_ratio FROM units u
    LEFT JOIN ({boundary_cells(10)}) c ON c.district_id = u.district_id
      AND c.cx // 25 = u.unit_no % 4 AND c.cy // 25 = u.unit_no // 4 GROUP BY 1, 2"""


@query("j6_overlap_by_cells", "SELECT unit_id, overlap_ratio, overlap_m2 FROM unit_cells",
       "overlap_ratio overlap_m2", extra={"unit_cells": UNIT_CELLS})
def _(L):
    return spatial.overlap_by_cells(L.units(), L.boundaries(), "unit_id", 10.0).select(
        "unit_id", "overlap_ratio", "overlap_m2")


@query("j6_overlap_exact")
def _(L):
    u = spatial.overlap_exact(L.units().select("district_id", "unit_id", "rings"), L.boundaries(),
                              "unit_id")
    return u.select("unit_id", "overlap_m2", "overlap_ratio", "fully_inside")


@query("j7_dominant_unit", """
    SELECT district_id, max_by(unit_id, (overlap_m2, -unit_id)) AS dominant_unit,
      max(overlap_m2) AS overlap_m2 FROM unit_cells WHERE overlap_m2 > 1 GROUP BY 1""", "overlap_m2",
       extra={"unit_cells": UNIT_CELLS})
def _(L):
    o = spatial.overlap_by_cells(L.units(), L.boundaries(), "unit_id", 10.0)
    return spatial.dominant_unit(o, "unit_id")


@query("j8_left_join_filled", """
    SELECT unit_id, coalesce(jobs, 0) AS jobs FROM units LEFT JOIN (
      SELECT district_id, block_no, sum(jobs) AS jobs FROM jobs_long GROUP BY ALL) j
    ON j.district_id = units.district_id AND j.block_no = units.unit_no""", "jobs")
def _(L):
    jobs = L.view("jobs_long").groupBy("district_id", "block_no").agg(
        F.sum("jobs").alias("jobs")).withColumnRenamed("block_no", "unit_no")
    return spatial.left_join_filled(L.view("units"), jobs, ["district_id", "unit_no"],
                                    {"jobs": 0.0}).select("unit_id", "jobs")


STOPS = "SELECT DISTINCT district_id, stop_id, x, y FROM stop_times"


@query("j9_two_way_match", """
    SELECT district_id, coalesce(m, 0) AS matched, coalesce(l, 0) AS only_left,
      coalesce(r, 0) AS only_right FROM (
      SELECT district_id, count(*) FILTER (WHERE hit) AS m, count(*) FILTER (WHERE NOT hit) AS l
      FROM (SELECT *, EXISTS (SELECT 1 FROM places p WHERE p.district_id = s.district_id
          AND pow(p.x - s.x, 2) + pow(p.y - s.y, 2) <= pow(76.2, 2)) AS hit FROM stops s) a GROUP BY 1) a
    FULL JOIN (SELECT district_id, count(*) AS r FROM places p WHERE NOT EXISTS (
      SELECT 1 FROM stops s WHERE p.district_id = s.district_id
      AND pow(p.x - s.x, 2) + pow(p.y - s.y, 2) <= pow(76.2, 2)) GROUP BY 1) b USING (district_id)""",
       extra={"stops": STOPS})
def _(L):
    stops = L.view("stop_times").select("district_id", "stop_id", "x", "y").distinct()
    return spatial.match_counts(stops, L.view("places").select("district_id", "place_id", "x", "y"),
                                250 * V.M_PER_FT)


@query("j10_near_far_shift", """
    SELECT district_id, program, count(*) FILTER (WHERE near) AS near_n,
      count(*) FILTER (WHERE NOT near) AS far_n FROM (
      SELECT p.district_id, p.program, EXISTS (SELECT 1 FROM place_bld b JOIN buildings0 g
        ON g.building_id = b.building_id WHERE g.tag = 'office' AND b.place_id = p.place_id
        AND b.dist <= 60) AS near FROM places_p p) q GROUP BY ALL""")
def _(L):
    sides = spatial.near_far(L.places(), L.buildings().where("tag = 'office'"), 60.0)
    return sides.groupBy("district_id", "program").agg(
        F.count(F.when(F.col("side") == "near", 1)).alias("near_n"),
        F.count(F.when(F.col("side") == "far", 1)).alias("far_n"))


@query("j11_stop_catchment", f"""
    SELECT district_id, stop_id, CASE WHEN inside THEN 'inside' ELSE 'buffer' END AS catchment
    FROM (SELECT s.district_id, s.stop_id, count(*) FILTER (WHERE {crosses('s.x', 's.y')}) % 2 = 1
        AS inside, sqrt(min(d2)) AS d FROM (SELECT s.*, e.x1, e.y1, e.x2, e.y2, e.i FROM stops s
          JOIN bnd e USING (district_id)) s
      JOIN LATERAL (SELECT s.x1, s.y1, s.x2, s.y2) e ON true
      JOIN LATERAL (SELECT pow(s.x - (s.x1 + t * (s.x2 - s.x1)), 2)
          + pow(s.y - (s.y1 + t * (s.y2 - s.y1)), 2) AS d2 FROM (SELECT least(greatest(
          ((s.x - s.x1) * (s.x2 - s.x1) + (s.y - s.y1) * (s.y2 - s.y1)) / (pow(s.x2 - s.x1, 2)
          + pow(s.y2 - s.y1, 2)), 0), 1) AS t) t) dd ON true
      GROUP BY ALL) q WHERE inside OR d <= 100""", extra={"stops": STOPS})
def _(L):
    stops = L.view("stop_times").select("district_id", "stop_id", "x", "y").distinct()
    return spatial.catchment(stops, L.boundaries(), 100.0).select("district_id", "stop_id",
                                                                  "catchment")


DBOX = ("SELECT district_id, (district_id % 7) * 0.7::double AS xmin, (district_id % 7) * 0.7 + 0.5::double"
        " AS xmax, (district_id // 7) * 0.3::double AS ymin, (district_id // 7) * 0.3 + 0.4::double AS ymax"
        " FROM districts")
TBOX = ("SELECT feed_id, trip_id, min(x) / 100 AS xmin, max(x) / 100 AS xmax, min(y) / 100 AS ymin,"
        " max(y) / 100 AS ymax FROM stop_times GROUP BY ALL")


@query("j12_box_overlap", """
    SELECT trip_id, district_id FROM tbox t JOIN dbox d ON t.xmin <= d.xmax AND d.xmin <= t.xmax
      AND t.ymin <= d.ymax AND d.ymin <= t.ymax
    WHERE t.xmax - t.xmin <= 6 AND t.ymax - t.ymin <= 6""", extra={"tbox": TBOX, "dbox": DBOX})
def _(L):
    t = L.view("stop_times").groupBy("feed_id", "trip_id").agg(
        (F.min("x") / 100).alias("xmin"), (F.max("x") / 100).alias("xmax"),
        (F.min("y") / 100).alias("ymin"), (F.max("y") / 100).alias("ymax"))
    d = L.view("districts").select(
        "district_id", ((F.col("district_id") % 7) * 0.7).alias("xmin"),
        ((F.col("district_id") % 7) * 0.7 + 0.5).alias("xmax"),
        (F.expr("district_id div 7") * 0.3).alias("ymin"),
        (F.expr("district_id div 7") * 0.3 + 0.4).alias("ymax"))
    return spatial.box_overlap(t, d, "trip_id", "district_id", max_span=6.0)


@query("j12_dominant_zone", """
    SELECT structure_id, district_id, occ FROM (SELECT structure_id, district_id,
      structure_id % 5 AS occ FROM structures) s JOIN (
      SELECT district_id, occ FROM (SELECT district_id, occ, row_number() OVER (
        PARTITION BY district_id ORDER BY count(*) DESC, occ) AS r FROM (
        SELECT district_id, structure_id % 5 AS occ FROM structures) q GROUP BY 1, 2) z WHERE r = 1) b
    USING (district_id, occ)""")
def _(L):
    s = L.view("structures").select("structure_id", "district_id",
                                    (F.col("structure_id") % 5).alias("occ"))
    return spatial.dominant_zone(s, "occ")


@query("j13_enclosing_region", """
    SELECT place_id, CASE WHEN zone = 'interior' THEN 'place' ELSE 'county_subdivision' END AS kind,
      CAST(CASE WHEN zone = 'interior' THEN z.district_id
        ELSE z.district_id * 16 + CAST(floor(x / 250) AS BIGINT) + 4 * CAST(floor(y / 250) AS BIGINT)
        END AS VARCHAR) AS region FROM place_zone z""")
def _(L):
    place = L.boundaries().withColumn("place_no", F.col("district_id"))
    return spatial.enclosing_region(
        L.view("places"), [("place", place, "place_no"), ("county_subdivision", L.units(), "unit_id")],
        "place_id").select("place_id", "kind", "region")


@query("j14_whole_unit_membership", f"""
    SELECT p.building_id FROM rep p JOIN bnd e ON e.district_id = p.district_id
      AND {crosses('p.x', 'p.y')} GROUP BY 1 HAVING count(*) % 2 = 1""", extra={"rep": REP_SQL})
def _(L):
    b = L.buildings().withColumn("_p", spatial.representative_point("rings")).select(
        "building_id", "district_id", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    return spatial.spatial_join(b, L.boundaries(), [], "left_semi").select("building_id")


@query("j15_residential_provenance", f"""
    SELECT r.building_id, via AS residential_via, CASE WHEN via = 'none' THEN 0 ELSE 1 END AS is_residential
    FROM (SELECT p.building_id, CASE WHEN attr IN ('residential', 'housing block') THEN 'building_tag'
        WHEN EXISTS (SELECT 1 FROM (SELECT e.building_id FROM bld_edges e WHERE e.building_id % 11 = 0
            AND e.district_id = p.district_id AND {crosses('p.x', 'p.y')} GROUP BY 1
            HAVING count(*) % 2 = 1) h) THEN 'osm_building'
        WHEN EXISTS (SELECT 1 FROM units u WHERE u.district_id = p.district_id AND u.unit_no % 5 = 0
            AND u.ux <= p.x AND p.x < u.ux + 250 AND u.uy <= p.y AND p.y < u.uy + 250)
          THEN 'osm_landuse' ELSE 'none' END AS via
      FROM (SELECT *, {pick(['residential', 'yes', 'housing block', 'warehouse', None], 'building_id % 13')}
        AS attr FROM rep) p) r""", extra={"rep": REP_SQL})
def _(L):
    attr = pick(["residential", "yes", "housing block", "warehouse", None], "building_id % 13")
    b = L.buildings().withColumn("attr", F.expr(attr))
    res = (b.where("building_id % 11 = 0").select("district_id", "rings", F.lit("building")
                                                   .alias("res_kind"))
           .unionByName(L.units().where("unit_no % 5 = 0").select(
               "district_id", "rings", F.lit("landuse").alias("res_kind"))))
    return spatial.residential_provenance(b, res, "building_id", "attr").drop("district_id")


ANCHORS = "SELECT * FROM bld_zone WHERE zone = 'interior' AND area_m2 > 4000"


@query("j16_corridors", """
    SELECT district_id, a_id, b_id, sum(n)::BIGINT AS poi_count,
      min_by(program, (-n, program)) AS dominant_program,
      any_value(greatest(1, len - 50)) AS corridor_length_m,
      sum(n) / any_value(greatest(1, len - 50)) * 100 AS density_per_100m FROM (
      SELECT district_id, a_id, b_id, len, program, count(*) AS n FROM (
        SELECT a.district_id, a.building_id AS a_id, b.building_id AS b_id, p.program, p.place_id,
          a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS bcy, p.x, p.y,
          sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) AS len
        FROM anchors a JOIN anchors b ON a.district_id = b.district_id AND a.building_id < b.building_id
        JOIN places_p p ON p.district_id = a.district_id) q
      WHERE ((x - ax) * (bx - ax) + (y - ay) * (bcy - ay)) / len BETWEEN 0 AND len
        AND abs((y - ay) * (bx - ax) - (x - ax) * (bcy - ay)) / len <= 50
        AND (SELECT dist FROM place_bld d WHERE d.place_id = q.place_id AND d.building_id = q.a_id) > 25
        AND (SELECT dist FROM place_bld d WHERE d.place_id = q.place_id AND d.building_id = q.b_id) > 25
      GROUP BY ALL) c GROUP BY ALL""", "corridor_length_m density_per_100m", extra={"anchors": ANCHORS})
def _(L):
    a = spatial.assign_zone(L.buildings().where("area_m2 > 4000"), L.boundaries(), "cx", "cy").where(
        "zone = 'interior'")
    return spatial.corridors(a, L.places(), "building_id")


@query("j17_distance_rings", """
    SELECT district_id, building_id, ring, min_by(program, (-n, program)) AS dominant_program,
      sum(n)::BIGINT AS n_places, max(n) AS n_dominant FROM (
      SELECT d.district_id, d.building_id, CAST(greatest(ceil(dist / 50) - 1, 0) AS INTEGER) AS ring,
        program, count(*) AS n FROM place_bld d JOIN anchors USING (building_id)
      WHERE dist > 0 AND dist <= 200 GROUP BY ALL) q GROUP BY ALL""",
       extra={"anchors": "SELECT building_id FROM buildings WHERE area_m2 > 4000"})
def _(L):
    return spatial.distance_rings(L.buildings().where("area_m2 > 4000"), L.places(), "building_id")


@query("j18_lookup_joins", f"""
    SELECT feed_id, mode, count(DISTINCT trip_id) AS trips FROM (SELECT feed_id, trip_id,
      {pick(['tram', 'subway', 'rail', 'bus', 'bus', 'bus', 'ferry', 'cable', 'monorail', 'monorail', 'tram', 'other'], 'route_id')}
      AS mode FROM stop_times) q GROUP BY ALL""")
def _(L):
    from townloom.functions.classify import route_mode
    from townloom.plans.classification import ROUTE_TYPE

    st = L.view("stop_times")
    trips = st.select("feed_id", "trip_id", "route_id").distinct()
    routes = st.select("feed_id", "route_id").distinct().select(
        "feed_id", "route_id", route_mode(F.expr(ROUTE_TYPE)).alias("mode"))
    return (trips.join(routes, ["feed_id", "route_id"]).groupBy("feed_id", "mode")
            .agg(F.count("*").alias("trips")))


LABEL_NAME = ("CASE s_suppkey % 6 WHEN 0 THEN code WHEN 1 THEN 'The City' || CAST(nk AS {str}) || ' stadium'"
              " WHEN 2 THEN substr(code, 4, 8) WHEN 3 THEN city WHEN 4 THEN 'Old ' || code || ' grounds' ELSE CAST(nk AS {str}) END")
LABELS = ("SELECT s_suppkey AS label_id, " + LABEL_NAME.format(str="VARCHAR") + " AS label_name, regexp_replace(lower(city),"
          " '[^a-z0-9]', '', 'g') AS city FROM supplier JOIN districts ON district_id = s_suppkey // 2")
CORE = ("regexp_replace(regexp_replace(regexp_replace(lower({c}), '^[0-9]+[_-]', ''), '[_-][a-z]{{2}}$', ''), "
        "'[^a-z0-9]', '', 'g')")
WORDS = "list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("j19_match_labels", """
    SELECT label_id, arg_min(district_id, (rk, single = 0, by_city)) AS district_id,
      (['exact', 'token', 'substring'])[min(rk)] AS matched_by, arg_min(by_city, (rk, single = 0, by_city)) AS by_city FROM (
      SELECT label_id, rk, by_city, min(district_id) AS district_id, (count(DISTINCT district_id) = 1)::INT AS single FROM (
        SELECT label_id, district_id, rk, by_city FROM met, (VALUES (false), (true)) v(by_city)
        WHERE NOT by_city OR holds_city) m GROUP BY 1, 2, 3) b
    WHERE single = 1 OR rk = 1 AND NOT by_city GROUP BY 1""", extra={
    "labels0": LABELS,
    "lab": f"SELECT label_id, city, {WORDS.format(c='label_name')} AS words, {CORE.format(c='label_name')} AS core FROM labels0",
    "dis": f"SELECT district_id, string_split_regex(lower(code), '[^a-z0-9]+') AS ws, {WORDS.format(c='code')} AS words, "
           f"{CORE.format(c='code')} AS core FROM districts",
    "city_of": """SELECT DISTINCT d.district_id, l.city FROM dis d, (SELECT DISTINCT city FROM lab) l, range(1, 8) a(i), range(1, 8) b(n)
      WHERE i + n - 1 <= len(d.ws) AND array_to_string(d.ws[i:i + n - 1], '') = l.city""",
    "met": """SELECT label_id, district_id, rk, EXISTS (SELECT 1 FROM city_of c WHERE c.district_id = m.district_id AND c.city = m.city)
        AS holds_city FROM (
        SELECT label_id, l.city, district_id, 1 AS rk FROM lab l JOIN dis d ON l.core = d.core WHERE l.core <> ''
        UNION SELECT label_id, l.city, district_id, 2 FROM lab l JOIN dis d ON len(list_intersect(l.words, d.words)) > 0
        UNION SELECT label_id, l.city, district_id, 3 FROM lab l JOIN dis d ON l.core <> '' AND d.core <> ''
          AND (contains(d.core, l.core) OR contains(l.core, d.core))) m"""})
def _(L):
    d = L.view("districts")
    s = L.table("supplier").select("s_suppkey", F.expr("s_suppkey div 2").alias("district_id"))
    lab = s.join(d.select("district_id", "code", "nk", "city"), "district_id").select(
        F.col("s_suppkey").alias("label_id"), "city", F.expr(LABEL_NAME.format(str="STRING")).alias("label_name"))
    return spatial.match_by_name(lab, d, "label_name", "code", "city")


GAPS = {
    "boxes": """SELECT building_id, district_id, least(x0, x1, x2, x3) AS xl, greatest(x0, x1, x2, x3)
        AS xh, least(y0, y1, y2, y3) AS yl, greatest(y0, y1, y2, y3) AS yh FROM buildings0""",
    "cand": """SELECT a.building_id, b.building_id AS other FROM buildings a JOIN boxes b
        ON a.district_id = b.district_id AND a.building_id <> b.building_id AND b.xl <= a.cx + 100
        AND b.xh >= a.cx - 100 AND b.yl <= a.cy + 100 AND b.yh >= a.cy - 100""",
    "gap0": f"""SELECT c.building_id, c.other, min(least({', '.join(
        'pow({0} - (q.x1 + {2} * (q.x2 - q.x1)), 2) + pow({1} - (q.y1 + {2} * (q.y2 - q.y1)), 2)'.format(
            px, py, f'least(greatest((({px}) - q.x1) * (q.x2 - q.x1) + (({py}) - q.y1) * (q.y2 - q.y1), 0)'
            ' / (pow(q.x2 - q.x1, 2) + pow(q.y2 - q.y1, 2)), 1)').replace('q.', t + '.')
        for px, py, t in (('o.x1', 'o.y1', 's'), ('s.x1', 's.y1', 'o')))})) AS d2,
        bool_or(((s.x2 - s.x1) * (o.y1 - s.y1) - (s.y2 - s.y1) * (o.x1 - s.x1))
          * ((s.x2 - s.x1) * (o.y2 - s.y1) - (s.y2 - s.y1) * (o.x2 - s.x1)) < 0
          AND ((o.x2 - o.x1) * (s.y1 - o.y1) - (o.y2 - o.y1) * (s.x1 - o.x1))
          * ((o.x2 - o.x1) * (s.y2 - o.y1) - (o.y2 - o.y1) * (s.x2 - o.x1)) < 0) AS crossing,
        count(DISTINCT o.i) FILTER (WHERE s.i = 0 AND ((o.y1 > s.y1) <> (o.y2 > s.y1))
          AND s.x1 < (o.x2 - o.x1) * (s.y1 - o.y1) / (o.y2 - o.y1) + o.x1) % 2 = 1 AS a_in_b,
        count(DISTINCT s.i) FILTER (WHERE o.i = 0 AND ((s.y1 > o.y1) <> (s.y2 > o.y1))
          AND o.x1 < (s.x2 - s.x1) * (o.y1 - s.y1) / (s.y2 - s.y1) + s.x1) % 2 = 1 AS b_in_a
        FROM cand c JOIN bld_edges s ON s.building_id = c.building_id
        JOIN bld_edges o ON o.building_id = c.other GROUP BY 1, 2""",
    "gaps": """SELECT building_id, other, CASE WHEN crossing OR a_in_b OR b_in_a THEN 0
        ELSE sqrt(d2) END AS gap FROM gap0"""}


@query("j21_spatial_context", """
    SELECT b.building_id, min(gap) AS nearest_neighbor_m, count(*) FILTER (WHERE gap <= 50)
      AS neighbors_within FROM buildings b LEFT JOIN gaps USING (building_id) GROUP BY 1""",
       "nearest_neighbor_m", extra=GAPS)
def _(L):
    return spatial.spatial_context(L.buildings()).drop("district_id")


@query("j22_boundary_revision", f"""
    SELECT district_id, CASE WHEN district_id % 3 = 0 THEN 'identical' WHEN 500 + radius + 20
        * (district_id % 3) <= 900 THEN 'light' ELSE 'heavy' END AS tier,
      round(100.0 * changed / old_n, 1) AS change_pct FROM districts JOIN (
      SELECT district_id, count(o.cx) AS old_n, count(*) FILTER (WHERE o.cx IS NULL OR n.cx IS NULL)
        AS changed FROM ({boundary_cells(10)}) o FULL JOIN (SELECT district_id,
          cx + 2 * (district_id % 3) AS cx, cy FROM ({boundary_cells(10)}) q) n
      USING (district_id, cx, cy) GROUP BY 1) c USING (district_id)""", "change_pct")
def _(L):
    old = L.boundaries().select("district_id", "rings")
    shift = F.col("district_id") % 3 * 20
    new = old.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(
        (p["x"] + shift).alias("x"), p["y"].alias("y")))))
    box = geo.ring_from((F.lit(0), F.lit(0)), (F.lit(900), F.lit(0)), (F.lit(900), F.lit(1000)),
                        (F.lit(0), F.lit(1000)), (F.lit(0), F.lit(0)))
    canvas = old.select("district_id", F.array(box).alias("rings"))
    return spatial.boundary_revision(old, new, canvas)
