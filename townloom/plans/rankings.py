"""Queries for ranks, percentiles and selections (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.operators import census, ranks
from townloom.plans.catalog import query


def steady(c):
    """A value to nine decimals: the last bits of a mean depend on the order in which it was added up."""
    return F.round(c.cast("decimal(38,15)").cast("double"), 9)


def district_income(L):
    """One income and population value per district.

    Means are sums of decimals, so districts of equal units tie, in whatever order their units are added.
    """
    mean = lambda c: F.round(F.sum(F.col(c).cast("decimal(38,15)")).cast("double") / F.count(c), 9)
    return L.view("units").groupBy("district_id").agg(
        F.sum("total_pop").alias("pop"), mean("median_gross_rent").alias("rent"), mean("median_age").alias("age"))


INC = ("SELECT district_id, sum(total_pop) AS pop, avg(median_gross_rent) AS rent,"
       " avg(median_age) AS age FROM units GROUP BY 1")


@query("w1_weighted_percentile", """
    SELECT i.district_id, round(100 * sum(CASE WHEN u.median_age <= i.age THEN total_pop ELSE 0 END)
      / sum(total_pop), 1) AS pct FROM inc i JOIN districts d USING (district_id)
    JOIN (SELECT u.*, region FROM units u JOIN districts USING (district_id)) u ON u.region = d.region
    WHERE total_pop > 0 GROUP BY 1""", "pct", extra={"inc": INC})
def _(L):
    d = L.view("districts").select("district_id", "region")
    units = L.view("units").join(d, "district_id").select("region", steady(F.col("median_age")).alias("median_age"), "total_pop")
    subj = district_income(L).join(d, "district_id").select("district_id", "region", "age")
    out = ranks.share_at_or_below(subj, units, ["region"], "age", "median_age", "total_pop", scale=100.0)
    return out.select("district_id", F.round("pct", 1).alias("pct"))


@query("w2_positioning", """
    SELECT i.district_id, metric, district_value, round(district_value / metro_value, 3) AS ratio FROM (
      UNPIVOT (SELECT district_id, rent, age FROM inc) ON rent, age INTO NAME metric VALUE district_value) i
    JOIN districts USING (district_id) JOIN (UNPIVOT (SELECT region, avg(rent) AS rent, avg(age) AS age
      FROM inc JOIN districts USING (district_id) GROUP BY 1) ON rent, age INTO NAME metric
      VALUE metro_value) m USING (region, metric)""", "district_value ratio", extra={"inc": INC})
def _(L):
    from townloom.operators.similarity import positioning

    d = district_income(L).join(L.view("districts").select("district_id", "region"), "district_id")
    metro = d.groupBy("region").agg(F.avg("rent").alias("rent"), F.avg("age").alias("age"))
    return positioning(d, metro, "region", ["rent", "age"]).select(
        "district_id", "metric", F.col("value").alias("district_value"), "ratio")


@query("w3_percentile_at_or_below", """
    SELECT district_id, cume_dist() OVER (ORDER BY age) AS pct FROM inc""", "pct", extra={"inc": INC})
def _(L):
    return ranks.percentile_of(district_income(L), [], "age", scale=1.0).select("district_id", "pct")


@query("w3_percentile_of_new_values", """
    SELECT place_id, (SELECT count(*) FROM places q WHERE q.district_id = p.district_id AND q.y <= p.x)
      / (SELECT count(*) FROM places q WHERE q.district_id = p.district_id) AS pct FROM places p""", "pct")
def _(L):
    p = L.view("places").select("district_id", "place_id", "x", "y")
    return ranks.share_at_or_below(p.select("district_id", "place_id", "x"), p.select(
        "district_id", "y"), ["district_id"], "x", "y").select("place_id", "pct")


@query("w4_percentile_strictly_below", """
    SELECT district_id, 100 - 100 * (rank() OVER (ORDER BY rent) - 1) / count(*) OVER ()::double AS pct
    FROM inc""", "pct", extra={"inc": INC})
def _(L):
    return ranks.percentile_of(district_income(L), [], "rent", strict=True, higher_is_better=False,
                               min_values=5).select("district_id", "pct")


@query("w5_rank_table", """
    SELECT district_id, row_number() OVER (ORDER BY pop DESC, district_id) AS rank,
      row_number() OVER (ORDER BY pop DESC, district_id) <= 3 AS is_best, median(pop) OVER () AS median
    FROM inc""", "median", extra={"inc": INC})
def _(L):
    d = district_income(L)
    med = ranks.quantiles(d, [], "pop", {"median": 0.5})
    r = ranks.ranked(d, "pop", "district_id").withColumn("is_best", F.col("rank") <= 3)
    return r.crossJoin(F.broadcast(med)).select("district_id", "rank", "is_best", "median")


@query("w6_pick_labels", """
    SELECT district_id, pop, why FROM (SELECT district_id, pop, CASE WHEN district_id = 3 THEN 'focus'
        WHEN district_id = (SELECT min_by(district_id, (pop, district_id)) FROM inc) THEN 'min'
        WHEN district_id = (SELECT min_by(district_id, (-pop, district_id)) FROM inc) THEN 'max'
        WHEN district_id = (SELECT min_by(district_id, (abs(pop - m), district_id)) FROM inc, (
          SELECT median(pop) AS m FROM inc) z) THEN 'median'
        WHEN contains(lower(code), 'city6-') THEN 'peer' END AS why
      FROM inc JOIN districts USING (district_id)) q WHERE why IS NOT NULL
    ORDER BY CASE WHEN why = 'peer' THEN 1 ELSE 0 END, district_id LIMIT 7""", "pop", extra={"inc": INC})
def _(L):
    d = district_income(L).join(L.view("districts").select("district_id", "code"), "district_id")
    return ranks.pick_labels(d, "district_id", "code", "pop", 3, ["City6-"], 7)


@query("w7_quintile_classes", """
    SELECT unit_id, CAST((v > q[1])::INT + (v > q[2])::INT + (v > q[3])::INT + (v > q[4])::INT AS INTEGER)
      AS class_index FROM (SELECT unit_id, district_id, median_age AS v FROM units) u
    JOIN (SELECT district_id, [s[floor(0.2 * n)::INT + 1], s[floor(0.4 * n)::INT + 1],
        s[floor(0.6 * n)::INT + 1], s[floor(0.8 * n)::INT + 1]] AS q
      FROM (SELECT district_id, list_sort(list(median_age)) AS s, count(*)::double AS n FROM units
        GROUP BY 1) a WHERE n >= 5) b USING (district_id)""")
def _(L):
    u = L.view("units").select("unit_id", "district_id", "median_age")
    b = ranks.quintile_breaks(u, ["district_id"], "median_age")
    return ranks.class_index(u, b, ["district_id"], "median_age").select("unit_id", "class_index")


@query("w8_top_categories", """
    SELECT parcel_id, CASE WHEN owner IN (SELECT owner FROM (SELECT district_id, owner, row_number() OVER (
        PARTITION BY district_id ORDER BY count(*) DESC, owner) AS r FROM parcels GROUP BY 1, 2) t
        WHERE r <= 12 AND t.district_id = p.district_id) THEN owner ELSE 'Other' END AS shown
    FROM parcels p""")
def _(L):
    return ranks.top_categories(L.view("parcels"), ["district_id"], "owner").select(
        "parcel_id", "shown")


MODS = "(VALUES ('jobs', true), ('program', false), ('environment', false)) m(module, us_only)"
MARKS = ("SELECT DISTINCT district_id, CASE segment WHEN 'BUILDING' THEN 'jobs' WHEN 'MACHINERY' THEN "
         "'program' ELSE 'environment' END AS module FROM places")


@query("w9_outstanding_work", f"""
    SELECT district_id, module, CASE WHEN us_only AND regexp_extract(code, '-([A-Z]{{2}})$', 1) IN
        ('ON', 'QC', 'BC', 'AB', 'MB', 'SK', 'NS', 'NB', 'NL', 'PE', 'NT', 'YT', 'NU') THEN 'skip-canada'
      WHEN radius <= 310 THEN 'skip-no-manifest' WHEN (district_id, module) IN (SELECT (district_id, module)
        FROM marks) THEN 'skip-already-done' ELSE 'todo' END AS state
    FROM districts, {MODS}""", extra={"marks": MARKS})
def _(L):
    mods = L.spark.createDataFrame([("jobs", True), ("program", False), ("environment", False)],
                                   "module string, us_only boolean")
    marks = L.view("places").select("district_id", F.expr(
        "CASE segment WHEN 'BUILDING' THEN 'jobs' WHEN 'MACHINERY' THEN 'program' "
        "ELSE 'environment' END").alias("module")).distinct()
    d = L.view("districts").withColumn("has_manifest", F.col("radius") > 310)
    return ranks.outstanding(d, mods, marks, "has_manifest", "code")


@query("w10_quartile_band", """
    SELECT region, quantile_cont(pop, 0.25) AS q1, quantile_cont(pop, 0.5) AS md,
      quantile_cont(pop, 0.75) AS q3 FROM inc JOIN districts USING (district_id) GROUP BY 1""", "q1 md q3",
       extra={"inc": INC})
def _(L):
    d = district_income(L).join(L.view("districts").select("district_id", "region"), "district_id")
    return ranks.quantiles(d, ["region"], "pop", {"q1": 0.25, "md": 0.5, "q3": 0.75})


@query("w11_greedy_dedup", """
    SELECT poi_id FROM (SELECT DISTINCT unnest(kept).id AS poi_id FROM g)""", extra={
    "ordered": """SELECT *, row_number() OVER (PARTITION BY district_id, name ORDER BY poi_id) AS n
        FROM poi_dump""",
    "g": """SELECT district_id, name, n, [{'id': poi_id, 'x': x, 'y': y}] AS kept FROM ordered WHERE n = 1
        UNION ALL SELECT g.district_id, g.name, o.n, CASE WHEN len(list_filter(g.kept,
          lambda k: pow(k.x - o.x, 2) + pow(k.y - o.y, 2) <= 625)) = 0
          THEN list_append(g.kept, {'id': o.poi_id, 'x': o.x, 'y': o.y}) ELSE g.kept END
        FROM g JOIN ordered o ON o.district_id = g.district_id AND o.name = g.name AND o.n = g.n + 1"""})
def _(L):
    from townloom.operators.dedup import greedy_dedup

    return greedy_dedup(L.view("poi_dump"), "poi_id", "name", 25.0).select("poi_id")


@query("w12_flag_filter", """
    SELECT district_id, count(*) AS n_input, count(*) FILTER (WHERE dup) AS dropped_duplicate,
      count(*) FILTER (WHERE NOT dup AND NOT op AND has_op) AS dropped_non_operational,
      any_value(has_op) AS operational_filter_applied,
      count(*) FILTER (WHERE NOT dup AND (op OR NOT has_op)) AS n_output
    FROM (SELECT *, coalesce(bool_or(op) FILTER (WHERE NOT dup) OVER (PARTITION BY district_id), false)
        AS has_op FROM (SELECT district_id, lower(is_duplicate) IN ('true', '1', 'yes') AS dup,
          lower(is_operational) IN ('true', '1', 'yes') AS op FROM places) p) q GROUP BY 1""")
def _(L):
    return ranks.flag_filter(L.view("places"), ["district_id"], "is_duplicate", "is_operational")[1]


@query("w13_min_max", """
    SELECT district_id, (pop - min(pop) OVER ()) / (max(pop) OVER () - min(pop) OVER ()) AS pop_scaled,
      0.5::double AS constant_scaled FROM inc""", "pop_scaled constant_scaled", extra={"inc": INC})
def _(L):
    d = district_income(L).withColumn("k", F.lit(7.0))
    return ranks.min_max(ranks.min_max(d, "pop", "pop_scaled"), "k", "constant_scaled").select(
        "district_id", "pop_scaled", "constant_scaled")


@query("w14_typical_sample")
def _(L):
    return ranks.typical_sample(L.view("structures").where("sqft is not null"), ["district_id"],
                                "structure_id", "sqft").select("district_id", "structure_id", "sqft")


@query("w14_sample_per_cell")
def _(L):
    s = L.view("structures").withColumn("cell", F.floor(F.col("x") / 250))
    return ranks.sample_per_cell(s, ["district_id", "cell"], "structure_id", 20).select(
        "district_id", "cell", "structure_id")


@query("w15_median_member", """
    SELECT district_id, cluster_id, any_value(m) AS median,
      min_by(building_id, (round(abs(area_m2 - m), 9), building_id)) AS representative
    FROM (SELECT *, median(area_m2) OVER (PARTITION BY district_id, cluster_id) AS m FROM buildings) q
    GROUP BY ALL""", "median")
def _(L):
    return ranks.median_member(L.buildings(), ["district_id", "cluster_id"], "building_id", "area_m2")


@query("w16_cohort", """
    SELECT district_id, coalesce(secondary, typology, 'unlabelled') AS label FROM districts
    WHERE district_id IN (SELECT district_id FROM inc WHERE pop > 290)""", extra={"inc": INC})
def _(L):
    cohort = district_income(L).where("pop > 290")
    return ranks.restrict_cohort(L.view("districts"), cohort, "district_id", "secondary",
                                 "typology").select("district_id", "label")
