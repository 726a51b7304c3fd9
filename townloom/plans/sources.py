"""Queries for sources, sinks and intake (S, X): data derived by Spark, written and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.operators import census
from townloom.plans.catalog import query
from townloom.plans.classification import leaf_case
from townloom.plans.fixtures import Layers
from townloom.session import scratch_path
from townloom.sources import readers, sinks
from townloom.streaming import intake


def wkb_of(x: str, y: str):
    """Little-endian WKB of a point, as an Arrow function."""
    @F.pandas_udf("binary")
    def encode(a: pd.Series, b: pd.Series) -> pd.Series:
        import struct

        return pd.Series([struct.pack("<BIdd", 1, 1, u, v) for u, v in zip(a, b)])

    return encode(x, y)


@query("s1_places_parquet", f"""
    SELECT place_id AS id, z.district_id, round(confidence, 3) AS confidence, {leaf_case('leaf')} AS program
    FROM place_zone z JOIN (SELECT place_id, confidence FROM places) USING (place_id)
    WHERE zone = 'interior' AND confidence >= 0.25""", "confidence")
def _(L: Layers):
    path = scratch_path(L.spark, "places")
    shift = F.col("district_id") * 1000
    p = L.view("places").withColumn("gx", F.col("x") + shift)
    p.select(F.col("place_id").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"),
             F.struct(F.col("leaf").alias("primary"), F.array().cast("array<string>").alias("alternate"))
             .alias("categories"), "confidence",
             F.struct(F.col("gx").alias("xmin"), F.col("gx").alias("xmax"), F.col("y").alias("ymin"),
                      F.col("y").alias("ymax")).alias("bbox"), wkb_of("gx", "y").alias("geometry"),
             F.lit("place").alias("type")).write.partitionBy("type").parquet(path)
    b = L.boundaries().withColumn("rings", F.transform("rings", lambda r: F.transform(
        r, lambda q: F.struct((q["x"] + F.col("district_id") * 1000).alias("x"), q["y"].alias("y")))))
    return readers.read_places(L.spark, path, b, 0.25).select("id", "district_id", "confidence", "program")


@query("s2_vector_layer", """
    SELECT CAST(building_id AS VARCHAR) AS building_id, tag, 0 AS part_no, area_m2 FROM buildings
    UNION ALL SELECT CAST(building_id AS VARCHAR), tag, 1, area_m2 FROM buildings WHERE building_id % 4 = 0""", "area_m2")
def _(L: Layers):
    path = scratch_path(L.spark, "layer")
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"], p["y"], F.lit(3.0)))
    poly = F.array(ring)
    multi = F.col("building_id") % 4 == 0
    geom = F.when(multi, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(F.array(poly, poly)),
                                  F.lit("}"))).otherwise(F.concat(
                                      F.lit('{"type":"Polygon","coordinates":'), F.to_json(poly), F.lit("}")))
    feat = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(
        F.col("building_id").cast("string").alias("building_id"), "tag")), F.lit(',"geometry":'), geom, F.lit("}"))
    b = L.buildings().select("district_id", (F.col("building_id") % 8).alias("part"), feat.alias("f"))
    docs = b.groupBy("district_id", "part").agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","),
        F.lit("]}")).alias("value"))
    docs.select("value").write.text(path)
    r = readers.read_layer(L.spark, path, ["Polygon", "MultiPolygon"], ["building_id", "tag"])
    return r.select("building_id", "tag", "part_no", geo.area("rings").alias("area_m2"))


@query("s3_gtfs_tables", """
    SELECT feed_id, CAST(trip_id AS VARCHAR) AS trip_id, count(*) AS stops, CAST(max(stop_id) AS VARCHAR) IS NOT NULL AS ok
    FROM stop_times GROUP BY ALL""")
def _(L: Layers):
    path = scratch_path(L.spark, "gtfs")
    st = L.view("stop_times").select("feed_id", F.col("trip_id").alias("﻿trip_id"),
                                     F.col("stop_id").alias(" stop_id "), "dep_s")
    st.write.option("header", True).partitionBy("feed_id").csv(f"{path}/stop_times")
    t = readers.read_gtfs(L.spark, path, "stop_times")
    return t.groupBy("feed_id", "trip_id").agg(F.count("*").alias("stops"),
                                               F.max("stop_id").isNotNull().alias("ok"))


@query("s4_jobs_gzip", """
    SELECT lpad(CAST(district_id * 100 + block_no AS VARCHAR), 15, '0') AS w_geocode, sum(jobs) AS jobs FROM jobs_long
    GROUP BY 1""", "jobs")
def _(L: Layers):
    path = scratch_path(L.spark, "jobs")
    census.jobs_wide(L.view("jobs_long"), ["district_id", "block_no"]).select(
        (F.col("district_id") * 100 + F.col("block_no")).alias("w_geocode"), "C000").write.option(
        "header", True).option("compression", "gzip").csv(path)
    return readers.read_jobs(L.spark, path).select("w_geocode", F.col("C000").alias("jobs"))


@query("s5_acs_extract", """
    SELECT '48' || lpad(CAST(district_id % 1000 AS VARCHAR), 3, '0') || lpad(CAST(unit_no AS VARCHAR), 6, '0') || '1'
      AS geoid, total_pop, CASE WHEN median_household_income <> -666666666 THEN median_household_income END
      AS median_household_income, NULL::double AS median_age FROM units""", "total_pop median_household_income median_age")
def _(L: Layers):
    path = scratch_path(L.spark, "acs")
    cell = lambda c: F.col(c).cast("string")
    row = F.array(cell("total_pop"), cell("median_household_income"), F.lit("n/a"), F.lit("48"),
                  (F.col("district_id") % 1000).cast("string"), cell("unit_no"), F.lit("1"))
    head = F.array(*[F.lit(v) for v in ("B01003_001E", "B19013_001E", "B01002_001E", "state", "county",
                                        "tract", "block group")])
    L.view("units").select("district_id", row.alias("r")).groupBy("district_id").agg(
        F.collect_list("r").alias("rs")).select(F.to_json(F.concat(F.array(head), "rs")).alias("value")
                                                ).write.text(path)
    return readers.read_acs(L.spark, path).select("geoid", "total_pop", "median_household_income", "median_age")


@query("s6_vintage_columns", """
    SELECT unit_id, yr, total_pop, CASE WHEN yr >= 2012 THEN edu_bachelors END AS edu_bachelors,
      CASE WHEN yr >= 2010 THEN unemployed END AS unemployed FROM units, (VALUES (2009), (2011), (2013)) y(yr)""",
       "total_pop edu_bachelors unemployed")
def _(L: Layers):
    u = L.view("units").select("unit_id", "total_pop", "edu_bachelors", "unemployed", F.explode(F.array(
        F.lit(2009), F.lit(2011), F.lit(2013))).alias("yr"))
    return readers.restrict_to_vintage(u, "yr", ["total_pop", "edu_bachelors", "unemployed"])


@query("s8_label_sheets", """
    SELECT district_id, CASE WHEN district_id % 3 = 0 THEN secondary ELSE NULL END AS secondary_typology,
      CASE WHEN district_id % 5 = 1 AND district_id % 3 <> 0 THEN NULL ELSE typology END AS primary_typology,
      district_id % 5 = 1 AND district_id % 3 <> 0 AS warned FROM districts""")
def _(L: Layers):
    d = L.view("districts")
    odd = F.when(F.col("district_id") % 5 == 1, "unspecified").otherwise(
        F.when(F.col("typology") == "Sports Park", "Sports Tourism").otherwise(F.col("typology")))
    basic = d.select("district_id", F.col("code").alias("name"), odd.alias("primary_typology"),
                     F.lit("").alias("notes"))
    rich = d.where("district_id % 3 = 0").select(
        F.col("code").alias("name"), F.col("typology").alias("primary_typology"),
        F.col("secondary").alias("secondary_typology"), F.lit("rich").alias("notes"))
    m, bad = readers.merge_labels(basic, rich)
    return m.join(bad.select("district_id", F.lit(True).alias("warned")), "district_id", "left").fillna(
        False, ["warned"]).select("district_id", "primary_typology", "secondary_typology", "warned")


@query("s9_registry", """
    SELECT district_id, TRY_CAST(regexp_extract(code, '^([0-9]+)_', 1) AS INTEGER) AS number, right(code, 2) AS state,
      replace(regexp_replace(list_last(string_split(code, '_')), '-[A-Z]{2}$', ''), '-', ' ') AS place,
      CASE WHEN right(code, 2) IN ('ON', 'BC') THEN 'needs-statcan' ELSE 'us-census' END AS census_basis FROM districts""")
def _(L: Layers):
    return readers.registry(L.view("districts")).drop("code")


@query("s10_partitioned_summaries", """
    SELECT district_id, count(*) AS n, sum(area_m2) AS area FROM buildings GROUP BY 1""", "area")
def _(L: Layers):
    path = scratch_path(L.spark, "summary")
    s = L.buildings().groupBy("district_id").agg(F.count("*").alias("n"), F.sum("area_m2").alias("area"))
    sinks.write_summaries(s, path)
    return L.spark.read.parquet(path).select(F.col("district_id").cast("long").alias("district_id"), "n", "area")


@query("s11_choropleth", """
    SELECT district_id, block_no, sum(jobs) FILTER (WHERE yr = 1996) AS jobs_1996, sum(jobs) FILTER (WHERE yr = 1999)
      AS jobs_1999 FROM jobs_long GROUP BY 1, 2""", "jobs_1996 jobs_1999")
def _(L: Layers):
    return census.choropleth(L.view("jobs_long"), ["district_id", "block_no"], "yr", "jobs", [1996, 1999])


@query("s12_thumbnails")
def _(L: Layers):
    t = sinks.thumbnails(L.buildings().select("district_id", "building_id", "rings"), "building_id")
    return t.select("district_id", "building_id", "rank", "drawn", F.size("ring").alias("points"))


@query("x1_streaming_intake", """
    SELECT c_custkey // 30 AS district_id, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL""")
def _(L: Layers):
    target = scratch_path(L.spark, "corpus")
    schema = L.table("customer").schema

    def summarise(batch):
        return batch.groupBy(F.expr("c_custkey div 30").alias("district_id"),
                             F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))

    intake.run_intake(L.spark, L.dir, schema, "customer.parquet", summarise, target,
                      scratch_path(L.spark, "intake-checkpoint"))
    return intake.merged_counts(L.spark, target, ["district_id", "segment"], "n")


@query("x2_label_overrides", """
    SELECT district_id, coalesce(o.label, d.typology) AS label, o.label IS NOT NULL AS confirmed FROM districts d
    LEFT JOIN (SELECT user_id // 3 AS district_id, arg_max(event_type, (ts, event_id)) AS label FROM events
      GROUP BY 1) o USING (district_id)""")
def _(L: Layers):
    log = L.table("events").select(
        F.expr("user_id div 3").alias("district_id"), F.col("event_type").alias("label"), "ts", "event_id")
    o = intake.latest_label(log, "district_id", "label", ["ts", "event_id"])
    return intake.apply_overrides(L.view("districts").select("district_id", F.col("typology").alias("label")),
                                  o, "district_id", "label")
