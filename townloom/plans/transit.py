"""Queries for transit schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from townloom.functions.classify import route_mode
from townloom.functions import vocab as V
from townloom.operators import spatial, transit
from townloom.plans.catalog import query
from townloom.plans.classification import ROUTE_TYPE
from townloom.plans.fixtures import crosses, seg_d2

# Weekday patterns of the five services of each feed.
PATTERNS = ["1111100", "1111111", "0000011", "0010100", "1010101"]
CAL = ("SELECT feed_id, service_id, min(day) AS lo, max(day) AS hi, (["
       + ", ".join(f"'{p}'" for p in PATTERNS) + "])[service_id + 1] AS pat FROM stop_times GROUP BY ALL")
EXC = ("SELECT DISTINCT feed_id, service_id, day, CASE WHEN service_id % 2 = 0 THEN '2' ELSE '1' END AS typ"
       " FROM stop_times WHERE event_type = 'signup' AND value > 60")
ACTIVE = """SELECT feed_id, day, service_id FROM (
      SELECT d.feed_id, d.day, c.service_id FROM asked d JOIN cal c ON c.feed_id = d.feed_id
        AND d.day BETWEEN c.lo AND c.hi AND substr(c.pat, isodow(d.day)::INT, 1) = '1'
      UNION SELECT e.feed_id, e.day, e.service_id FROM exc e JOIN asked USING (feed_id, day) WHERE typ = '1') a
    WHERE (feed_id, day, service_id) NOT IN (SELECT (feed_id, day, service_id) FROM exc WHERE typ = '2')"""
DAYS = "SELECT DISTINCT feed_id, day FROM stop_times"
MODES = ("(VALUES (0, 'tram'), (1, 'subway'), (2, 'rail'), (3, 'bus'), (4, 'bus'), (5, 'bus'),"
         " (6, 'ferry'), (7, 'cable'), (8, 'monorail'), (9, 'monorail'), (10, 'tram'), (11, 'other'))"
         " m(route_id, mode)")


def calendars(L):
    st = L.view("stop_times")
    cal = st.groupBy("feed_id", "service_id").agg(F.min("day").alias("start_date"),
                                                  F.max("day").alias("end_date"))
    pat = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), F.col("service_id").cast("int") + 1)
    for i, d in enumerate(V.WEEKDAYS):
        cal = cal.withColumn(d, F.substring(pat, i + 1, 1))
    exc = st.where("event_type = 'signup' and value > 60").select(
        "feed_id", "service_id", F.col("day").alias("date"),
        F.when(F.col("service_id") % 2 == 0, "2").otherwise("1").alias("exception_type")).distinct()
    return cal, exc


@query("t8_active_services", "SELECT feed_id, day AS date, service_id FROM active",
       extra={"cal": CAL, "exc": EXC, "asked": DAYS, "active": ACTIVE})
def _(L):
    cal, exc = calendars(L)
    days = L.view("stop_times").select("feed_id", F.col("day").alias("date")).distinct()
    return transit.active_services(cal, exc, days)


REP = """SELECT feed_id, arg_min(day, (-n, dist, day)) AS date, arg_min(n, (-n, dist, day)) AS n_services FROM (
      SELECT a.feed_id, a.day, count(x.service_id) AS n, abs(date_diff('day', DATE '2024-01-20', a.day)) AS dist
      FROM asked a LEFT JOIN active x USING (feed_id, day) GROUP BY ALL) q GROUP BY 1"""
# the half-year window covers the whole feed here, so every Wednesday of the feed is a candidate
WEDS = """SELECT DISTINCT feed_id, day FROM (
      SELECT feed_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (
        SELECT feed_id, min(day) AS lo, max(day) AS hi FROM stop_times GROUP BY 1) s) d
      WHERE isodow(day) = 3 UNION SELECT feed_id, day FROM exc WHERE typ = '1'"""


@query("t7_representative_date", "SELECT * FROM rep",
       extra={"cal": CAL, "exc": EXC, "asked": WEDS, "active": ACTIVE, "rep": REP})
def _(L):
    cal, exc = calendars(L)
    return transit.representative_dates(cal, exc, "2024-01-20")


def service_sql(source: str) -> dict:
    """CTEs: level of service of the departures of `source`."""
    return {
        "st": f"SELECT s.*, mode FROM ({source}) s JOIN {MODES} USING (route_id) WHERE dep_s < 100800",
        "mid": "SELECT * FROM st WHERE dep_s >= 36000 AND dep_s < 54000",
        "los": f"""
    SELECT district_id, count(DISTINCT (feed_id, trip_id)) AS trips_per_day,
      count(DISTINCT (feed_id, route_id)) AS routes_serving,
      string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, CAST(count(DISTINCT mode) AS INTEGER) AS n_modes,
      any_value(best) AS busiest_stop_departures, any_value(node) AS busiest_node_headway_min,
      any_value(med) AS median_route_headway_min, any_value(outside) AS departures_outside_day,
      round((max(dep_s) - min(dep_s)) / 3600.0, 1) AS span_hours
    FROM st JOIN (SELECT district_id, count(*) FILTER (WHERE dep_s < 0 OR dep_s >= 100800) AS outside FROM ({source}) a GROUP BY 1) o
      USING (district_id)
    LEFT JOIN (SELECT district_id, max(n) AS best FROM (SELECT district_id, feed_id, stop_id,
        count(DISTINCT trip_id) AS n FROM st GROUP BY ALL) q GROUP BY 1) b USING (district_id)
    LEFT JOIN (SELECT district_id, round(300.0 / max(n), 1)::double AS node FROM (SELECT district_id, feed_id,
        stop_id, count(DISTINCT trip_id) AS n FROM mid GROUP BY ALL) q GROUP BY 1) c USING (district_id)
    LEFT JOIN (SELECT district_id, round(median(h), 1) AS med FROM (SELECT district_id, 300.0::double / max(n) AS h
        FROM (SELECT district_id, feed_id, route_id, stop_id, count(DISTINCT trip_id) AS n FROM mid
        GROUP BY ALL) q GROUP BY district_id, feed_id, route_id) r GROUP BY 1) d USING (district_id)
    GROUP BY 1"""}


LOS_COLS = "busiest_node_headway_min median_route_headway_min span_hours"


def route_modes(L):
    return L.view("stop_times").select("feed_id", "route_id").distinct().withColumn("mode", route_mode(F.expr(ROUTE_TYPE)))


@query("a14_level_of_service", "SELECT * FROM los", LOS_COLS, extra=service_sql("SELECT * FROM stop_times"))
def _(L):
    return transit.level_of_service(L.view("stop_times"), route_modes(L))


# Stops inside the boundary or within 100 m of it, and on their feed's representative day the trips of active services.
CAUGHT = f"""
    SELECT district_id, feed_id, stop_id, inside FROM (SELECT s.district_id, s.feed_id, s.stop_id,
        count(*) FILTER (WHERE {crosses('s.x', 's.y')}) % 2 = 1 AS inside, min({seg_d2('s.x', 's.y')}) AS d2
      FROM (SELECT DISTINCT district_id, feed_id, stop_id, x, y FROM stop_times) s JOIN bnd e USING (district_id) GROUP BY ALL) q
    WHERE inside OR sqrt(d2) <= 100"""
SERVED = """SELECT s.* FROM stop_times s JOIN (SELECT DISTINCT district_id, feed_id, stop_id FROM caught) c
      USING (district_id, feed_id, stop_id)
    WHERE EXISTS (SELECT 1 FROM rep r JOIN active a ON a.feed_id = r.feed_id AND a.day = r.date
      WHERE a.feed_id = s.feed_id AND a.service_id = s.service_id)
      OR NOT EXISTS (SELECT 1 FROM rep r JOIN active a ON a.feed_id = r.feed_id AND a.day = r.date WHERE a.feed_id = s.feed_id)"""
SERVICE = {"cal": CAL, "exc": EXC, "asked": WEDS, "active": ACTIVE, "rep": REP, "caught": CAUGHT, **service_sql(SERVED)}


def caught_stops(L):
    stops = L.view("stop_times").select("district_id", "feed_id", "stop_id", "x", "y").distinct()
    return spatial.catchment(stops, L.boundaries(), 100.0)


def served_departures(L):
    """J11, T7, T8 in a row: departures of active trips at stops of the catchment."""
    cal, exc = calendars(L)
    days = transit.representative_dates(cal, exc, "2024-01-20").select("feed_id", "date")
    running = transit.restrict_to_active(L.view("stop_times"), transit.active_services(cal, exc, days))
    stops = caught_stops(L).select("district_id", "feed_id", "stop_id").distinct()
    return running.join(stops, ["district_id", "feed_id", "stop_id"], "left_semi")


@query("a14_service_of_catchment", "SELECT * FROM los", LOS_COLS, extra=SERVICE)
def _(L):
    return transit.level_of_service(served_departures(L), route_modes(L))


@query("a14_restricted_to_active", """
    SELECT service_basis, count(*) AS n FROM (SELECT CASE WHEN s.feed_id = 'F3' THEN 'all_trips_approx'
        ELSE 'representative_weekday' END AS service_basis FROM stop_times s
      WHERE s.feed_id = 'F3' OR EXISTS (SELECT 1 FROM rep r JOIN active a ON a.feed_id = r.feed_id
        AND a.day = r.date WHERE a.feed_id = s.feed_id AND a.service_id = s.service_id)) q GROUP BY 1""",
       extra={"cal": CAL, "exc": EXC, "asked": WEDS, "active": ACTIVE, "rep": REP})
def _(L):
    cal, exc = calendars(L)
    days = transit.representative_dates(cal, exc, "2024-01-20").select("feed_id", "date")
    act = transit.active_services(cal, exc, days).where("feed_id <> 'F3'")
    return transit.restrict_to_active(L.view("stop_times"), act).groupBy("service_basis").agg(
        F.count("*").alias("n"))


@query("a44_routes_serving_boundary")
def _(L):
    st = L.view("stop_times").withColumn("mode", route_mode(F.expr(ROUTE_TYPE)))
    w = Window.partitionBy("feed_id", "trip_id", "district_id").orderBy("seq")
    seg = st.select("district_id", "feed_id", "route_id", "mode", F.col("x").alias("x1"),
                    F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"),
                    F.lead("y").over(w).alias("y2")).where("x2 is not null")
    return transit.routes_serving(seg, L.boundaries())
