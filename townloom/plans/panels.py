"""Queries for time series and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.operators import census
from townloom.plans.catalog import query


@query("t1_acs_panel", """
    SELECT district_id, yr, CASE WHEN yr >= 2020 THEN 2020 ELSE 2010 END AS vintage, metric, value FROM (
      UNPIVOT (SELECT district_id, yr, pop, income, rent FROM panel) ON pop, income, rent
      INTO NAME metric VALUE value) u""", "value")
def _(L):
    return census.acs_panel(L.view("panel"), ["pop", "income", "rent"])


@query("t2_slopes", """
    SELECT district_id, coalesce(regr_slope(pop, yr), 0) AS pop_trend,
      coalesce(regr_slope(pct_owner, yr), 0) AS pct_owner_trend FROM panel GROUP BY 1""",
       "pop_trend pct_owner_trend")
def _(L):
    return census.slopes(L.view("panel"), ["pop", "pct_owner"])


LEVEL = """SELECT p.district_id, max_by(pop, yr) / (any_value(radius) / 1000) AS demo_pop_density,
      coalesce(max_by(coalesce(pct_owner, -1), yr), 0) AS demo_pct_owner_occupied,
      max_by(income, yr) AS econ_median_income, max_by(home_value, yr) AS econ_median_home_value,
      max_by(rent, yr) AS econ_median_gross_rent, coalesce(regr_slope(pop, yr), 0) AS demo_pop_trend,
      coalesce(regr_slope(pct_owner, yr), 0) AS demo_ownership_trend,
      coalesce(regr_slope(income, yr), 0) AS econ_income_trend,
      coalesce(regr_slope(home_value, yr), 0) AS econ_home_value_trend
    FROM panel p JOIN districts USING (district_id) GROUP BY 1"""
LEVEL_COLS = ("demo_pop_density demo_pct_owner_occupied econ_median_income econ_median_home_value "
              "econ_median_gross_rent demo_pop_trend demo_ownership_trend econ_income_trend "
              "econ_home_value_trend")


@query("t3_level_and_trend", LEVEL, LEVEL_COLS)
def _(L):
    area = L.view("districts").select("district_id", (F.col("radius") / 1000).alias("area_km2"))
    return census.level_and_trend(L.view("panel"), area)


YEARLY = ("SELECT district_id, yr, sum(jobs) AS jobs, 100 * sum(CASE WHEN band = 2 THEN jobs ELSE 0 END)"
          " / sum(jobs) AS high_pct FROM jobs_long GROUP BY ALL")


def yearly_jobs(L):
    return L.view("jobs_long").groupBy("district_id", "yr").agg(
        F.sum("jobs").alias("jobs"),
        (100.0 * F.sum(F.when(F.col("band") == 2, F.col("jobs")).otherwise(0.0)) / F.sum("jobs"))
        .alias("high_pct"))


@query("t4_series_trend", """
    SELECT district_id, f AS first_year, l AS last_year, v0 AS first, v1 AS last, peak, peak_year,
      v1 - v0 AS change, round(100 * (v1 - v0) / v0, 1) AS pct_change,
      round(100 * (pow(v1 / v0, 1.0 / (l - f)) - 1), 1) AS cagr_pct FROM (
      SELECT district_id, min(yr) AS f, max(yr) AS l, arg_min(jobs, yr) AS v0, arg_max(jobs, yr) AS v1,
        max(jobs) AS peak, min_by(yr, (-jobs, yr)) AS peak_year FROM yearly GROUP BY 1) q""",
       "first last peak change pct_change cagr_pct", extra={"yearly": YEARLY})
def _(L):
    return census.series_trend(yearly_jobs(L), "jobs")


@query("t5_pre_post", """
    SELECT district_id, milestone, round(a, 1) AS jobs_pre, round(b, 1) AS jobs_post,
      round(100 * (b - a) / a, 1) AS jobs_delta, round(c, 1) AS high_pct_pre, round(d, 1) AS high_pct_post,
      round(d - c, 1) AS high_pct_delta,
      CASE WHEN y1a > y0a THEN round(100 * (pow(v1a / v0a, 1.0 / (y1a - y0a)) - 1), 2) END AS cagr_pre,
      CASE WHEN y1b > y0b THEN round(100 * (pow(v1b / v0b, 1.0 / (y1b - y0b)) - 1), 2) END AS cagr_post,
      CASE WHEN lo > milestone - 1 THEN 'pre_window_unavailable' WHEN hi < milestone + 1
        THEN 'post_window_unavailable' ELSE '' END AS flags
    FROM (SELECT district_id, any_value(ms) AS milestone, min(yr) AS lo, max(yr) AS hi,
        avg(jobs) FILTER (WHERE pre) AS a, avg(jobs) FILTER (WHERE post) AS b,
        avg(high_pct) FILTER (WHERE pre) AS c, avg(high_pct) FILTER (WHERE post) AS d,
        min(yr) FILTER (WHERE pre) AS y0a, max(yr) FILTER (WHERE pre) AS y1a,
        min(yr) FILTER (WHERE post) AS y0b, max(yr) FILTER (WHERE post) AS y1b,
        arg_min(jobs, yr) FILTER (WHERE pre) AS v0a, arg_max(jobs, yr) FILTER (WHERE pre) AS v1a,
        arg_min(jobs, yr) FILTER (WHERE post) AS v0b, arg_max(jobs, yr) FILTER (WHERE post) AS v1b
      FROM (SELECT *, yr BETWEEN ms - 3 AND ms - 1 AS pre, yr BETWEEN ms + 1 AND ms + 3 AS post FROM (
        SELECT *, CAST(1994 + district_id % 8 AS INTEGER) AS ms FROM yearly) y) z GROUP BY 1) q""",
       "jobs_pre jobs_post jobs_delta high_pct_pre high_pct_post high_pct_delta cagr_pre cagr_post",
       extra={"yearly": YEARLY})
def _(L):
    ms = L.view("districts").select("district_id", (1994 + F.col("district_id") % 8).cast("int")
                                    .alias("milestone"))
    out = census.pre_post(yearly_jobs(L), ms, "jobs", ["high_pct"])
    return out.withColumn("flags", F.array_join("flags", ","))


@query("t6_acs_pre_post", """
    SELECT district_id, i AS income_delta_pct, h AS home_value_delta_pct, r AS rent_delta_pct, renter_delta,
      b AS bachelors_delta, p AS population_delta_pct, round((r + h + b) / 3, 2) AS reinvestment FROM (
      SELECT a.district_id, round(100 * (z.income - a.income) / a.income, 1) AS i,
        round(100 * (z.home_value - a.home_value) / a.home_value, 1) AS h,
        round(100 * (z.rent - a.rent) / a.rent, 1) AS r,
        round(z.pct_renter - a.pct_renter, 1) AS renter_delta,
        round(z.pct_bachelors - a.pct_bachelors, 1) AS b, round(100 * (z.pop - a.pop) / a.pop, 1) AS p
      FROM (SELECT * FROM panel WHERE yr = 1996) a JOIN (SELECT * FROM panel WHERE yr = 2000) z
      USING (district_id)) q""",
       "income_delta_pct home_value_delta_pct rent_delta_pct renter_delta bachelors_delta "
       "population_delta_pct reinvestment")
def _(L):
    p = L.view("panel").drop("pct_owner")
    return census.acs_pre_post(p.where("yr = 1996").drop("yr"), p.where("yr = 2000").drop("yr"))


@query("t9_newest_complete_year", """
    SELECT district_id, max(yr) AS yr FROM (SELECT t.district_id, a.yr FROM touched t JOIN avail a
      USING (state) JOIN need n USING (district_id) GROUP BY ALL HAVING count(*) = any_value(n.need)) z
    GROUP BY 1""", extra={
    "touched": "SELECT DISTINCT district_id, segment AS state FROM places",
    "need": "SELECT district_id, count(*) AS need FROM touched GROUP BY 1",
    "avail": """SELECT DISTINCT c_mktsegment AS state, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders
        JOIN customer ON c_custkey = o_custkey"""})
def _(L):
    touched = L.view("places").select("district_id", F.col("segment").alias("state"))
    avail = L.table("orders").join(
        L.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("state"), F.year("o_orderdate").alias("yr"))
    return census.newest_complete_year(avail, touched)


@query("t10_yearly_unit_attributes", """
    SELECT district_id * 16 + u AS unit_id, yr, count(*)::double AS pop, avg(price) AS income FROM (
      SELECT o_custkey // 30 AS district_id, (o_orderkey // 7) % 16 AS u, o_totalprice AS price,
        CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders) q GROUP BY ALL""", "pop income")
def _(L):
    o = L.table("orders").select(
        (F.expr("o_custkey div 30") * 16 + F.expr("(o_orderkey div 7) % 16")).alias("unit_id"),
        F.year("o_orderdate").alias("yr"), "o_totalprice")
    return o.groupBy("unit_id", "yr").agg(F.count("*").cast("double").alias("pop"),
                                          F.avg("o_totalprice").alias("income"))
