"""Transit schedules: lines, service days and level of service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.operators.ranks import quantiles
from townloom.session import cut


def lines_from_points(points: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One line per key from ordered points, with its length. A key is one trip or shape."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(order, "x", "y"))),
                       lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return points.groupBy(*keys).agg(line.alias("line")).withColumn(
        "length_m", geo.line_length("line"))


def longest_line(lines: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """The longest line per route; ties take the smaller id."""
    best = F.max_by(F.struct(ident, "length_m", "line"),
                    F.struct(F.round("length_m", 4), -F.col(ident)))
    return lines.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col(f"_b.{ident}").alias(ident), F.col("_b.length_m").alias("length_m"),
        F.col("_b.line").alias("line"))


def route_lines(shapes: DataFrame, trips: DataFrame, keys: list[str]) -> DataFrame:
    """Longest shape per route; a route without shapes takes its longest stop sequence."""
    by_shape = longest_line(shapes, keys, "ident").withColumn("basis", F.lit("shape"))
    by_trip = longest_line(trips, keys, "ident").withColumn("basis", F.lit("stops"))
    return by_shape.unionByName(by_trip.join(by_shape.select(*keys), keys, "left_anti"))


def active_services(calendar: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """Services running on each asked (feed_id, date).

    Weekday pattern within the validity range, plus added, minus removed services.
    """
    weekday = F.weekday("date")
    runs = F.element_at(F.array(*[F.col(d).cast("string") for d in V.WEEKDAYS]),
                        weekday.cast("int") + 1) == "1"
    base = (dates.join(calendar, "feed_id")
            .where(runs & F.col("date").between(F.col("start_date"), F.col("end_date")))
            .select("feed_id", "date", "service_id"))
    asked = exceptions.join(dates, ["feed_id", "date"], "left_semi")
    added = asked.where("exception_type = '1'").select("feed_id", "date", "service_id")
    removed = asked.where("exception_type = '2'").select("feed_id", "date", "service_id")
    return base.union(added).distinct().join(removed, ["feed_id", "date", "service_id"], "left_anti")


def representative_dates(calendar: DataFrame, exceptions: DataFrame, as_of: str) -> DataFrame:
    """The most served Wednesday within half a year, or added date, nearest to `as_of`.

    The anchor is `as_of` clamped to the feed's validity; ties go to the date closest to
    `as_of`, then the earlier one. A feed without candidates takes the anchor itself.
    """
    span = (calendar.select("feed_id", F.col("start_date").alias("lo"), F.col("end_date").alias("hi"))
            .union(exceptions.select("feed_id", "date", "date"))
            .groupBy("feed_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    today = F.to_date(F.lit(as_of))
    anchor = F.least(F.greatest(today, F.col("lo")), F.col("hi"))
    span = span.withColumn("anchor", anchor).withColumn(
        "base", F.date_sub("anchor", F.weekday("anchor") - 2))
    weeks = F.transform(F.sequence(F.lit(-26), F.lit(26)),
                        lambda w: F.date_add(F.col("base"), w * 7))
    wed = span.select("feed_id", "lo", "hi", F.explode(weeks).alias("date"))
    adds = span.join(exceptions.where("exception_type = '1'").select("feed_id", "date"), "feed_id"
                     ).select("feed_id", "lo", "hi", "date")
    cand = wed.union(adds).where(F.col("date").between(F.col("lo"), F.col("hi"))).select(
        "feed_id", "date").distinct()
    cand = cand.unionByName(span.join(cand, "feed_id", "left_anti").select(
        "feed_id", F.col("anchor").alias("date")))
    cand = cut(cand)  # at most 53 dates and the added ones per feed, read several times below
    n = active_services(calendar, exceptions, cand).groupBy("feed_id", "date").agg(
        F.count("*").alias("n_services"))
    scored = cand.join(n, ["feed_id", "date"], "left").fillna(0, ["n_services"])
    best = F.min_by(F.struct("date", "n_services"), F.struct(
        -F.col("n_services"), F.abs(F.date_diff("date", today)), "date"))
    return scored.groupBy("feed_id").agg(best.alias("_b")).select(
        "feed_id", F.col("_b.date").alias("date"), F.col("_b.n_services").alias("n_services"))


def level_of_service(stop_times: DataFrame, routes: DataFrame, keys=("district_id",)) -> DataFrame:
    """Service of the served stops of each district.

    `stop_times` holds only active trips (feed_id, stop_id, trip_id, route_id, dep_s) of stops
    in the catchment; `routes` gives the mode. Trip and route ids are per feed. Departures before 0:00 or
    from 28:00 on belong to no service day and are counted in `departures_outside_day`. One pass over the
    departures leaves a row per trip and stop; all distinct counts are taken from those rows.
    """
    k = list(keys)
    day = (F.col("dep_s") >= 0) & (F.col("dep_s") < V.SERVICE_DAY_MAX_S)
    noon = (F.col("dep_s") >= V.MIDDAY_START_S) & (F.col("dep_s") < V.MIDDAY_END_S)
    calls = stop_times.groupBy(*k, "feed_id", "route_id", "trip_id", "stop_id").agg(
        F.min(F.when(day, F.col("dep_s"))).alias("_a"), F.max(F.when(day, F.col("dep_s"))).alias("_z"),
        F.max(F.when(noon, 1).otherwise(0)).alias("_noon"),
        F.count(F.when(~F.coalesce(day, F.lit(False)), 1)).alias("_out"))
    # trips at each stop of each route, then stops; a trip serves a stop on one route
    per_line = calls.groupBy(*k, "feed_id", "route_id", "stop_id").agg(
        F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.count("_a").alias("_n"), F.sum("_noon").alias("_mid"), F.sum("_out").alias("_out"))
    per_line = cut(per_line)
    window_min = (V.MIDDAY_END_S - V.MIDDAY_START_S) / 60
    per_stop = per_line.groupBy(*k, "feed_id", "stop_id").agg(F.sum("_n").alias("_n"), F.sum("_mid").alias("_mid")).groupBy(*k).agg(
        F.max("_n").alias("busiest_stop_departures"), F.max("_mid").alias("_best"))
    per_route = per_line.groupBy(*k, "feed_id", "route_id").agg(
        F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.max("_mid").alias("_mid"), F.sum("_out").alias("_out")).join(
        routes.select("feed_id", "route_id", "mode").distinct(), ["feed_id", "route_id"], "left")
    per_route = per_route.withColumn("mode", F.when(F.col("_a").isNotNull(), F.coalesce("mode", F.lit("other")))).withColumn(
        "_h", F.when(F.col("_mid") > 0, window_min / F.col("_mid")))
    per_route = cut(per_route)
    base = per_route.groupBy(*k).agg(
        F.min("_a").alias("_a"), F.max("_z").alias("_z"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"),
        F.size(F.collect_set("mode")).alias("n_modes"), F.count("_a").alias("routes_serving"),
        F.sum("_out").alias("departures_outside_day")).where("_a IS NOT NULL")
    trips = calls.where("_a IS NOT NULL").select(*k, "feed_id", "trip_id").distinct().groupBy(*k).agg(F.count("*").alias("trips_per_day"))
    head = quantiles(per_route, k, "_h", {"_m": 0.5}).select(*k, F.round("_m", 1).alias("median_route_headway_min"))
    out = base
    for part in (trips, per_stop, head):
        out = out.join(part, k, "left")
    return out.withColumn("busiest_node_headway_min", F.when(F.col("_best") > 0, F.round(window_min / F.col("_best"), 1))).withColumn(
        "span_hours", F.round((F.col("_z") - F.col("_a")) / 3600, 1)).drop("_a", "_z", "_best")


def restrict_to_active(stop_times: DataFrame, services: DataFrame) -> DataFrame:
    """Trips of active services; without any resolvable service all trips count, flagged."""
    found = services.select("feed_id").distinct().withColumn("_known", F.lit(True))
    active = stop_times.join(services.select("feed_id", "service_id").distinct(),
                             ["feed_id", "service_id"], "left_semi").withColumn(
        "service_basis", F.lit("representative_weekday"))
    rest = stop_times.join(found, "feed_id", "left_anti").withColumn(
        "service_basis", F.lit("all_trips_approx"))
    return active.unionByName(rest)


def routes_serving(lines: DataFrame, boundaries: DataFrame, size: float = 25.0,
                   keys=("district_id",)) -> DataFrame:
    """Routes whose line passes through the boundary, counted by mode.

    `lines` has one row per segment (x1, y1, x2, y2) with feed_id, route_id and mode.
    """
    from townloom.operators.spatial import cell_cover, line_cover

    road = line_cover(lines.withColumn("_w", F.lit(size * 0.75)), size,
                      [*keys, "feed_id", "route_id", "mode"], "_w")
    area = cell_cover(boundaries, size, [*keys])
    hit = road.join(area, [*keys, "cell_x", "cell_y"], "left_semi").select(
        *keys, "feed_id", "route_id", "mode").distinct()
    return hit.groupBy(*keys, "mode").agg(F.count("*").alias("routes"))
