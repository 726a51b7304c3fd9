"""Readers for district inputs (S1-S6, S8, S9). All of them return typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.functions.classify import bucket_with_alternates, canonical_typology
from townloom.functions.num import null_if_sentinel
from townloom.functions.shapes import wkb_point
from townloom.operators.spatial import spatial_join


def read_places(spark: SparkSession, path: str, districts: DataFrame, min_confidence: float = 0.0,
                categories: list[str] | None = None) -> DataFrame:
    """Places inside the districts from nested, hive-partitioned Parquet.

    The overall box of the districts and the confidence floor are plain comparisons on struct
    fields, which Parquet skips row groups by; the exact test runs on what is left. `districts`
    has district_id and rings in the coordinates of the places.
    """
    from townloom.functions import geo

    box = geo.bbox("rings")
    b = districts.select(box.alias("b")).agg(
        F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"),
        F.max("b.ymax").alias("ymax")).first()
    raw = spark.read.parquet(path)
    hit = raw.where((F.col("bbox.xmin") >= b["xmin"]) & (F.col("bbox.xmax") <= b["xmax"])
                    & (F.col("bbox.ymin") >= b["ymin"]) & (F.col("bbox.ymax") <= b["ymax"])
                    & (F.col("confidence") >= min_confidence))
    if categories:
        hit = hit.where(F.col("categories.primary").isin(categories))
    flat = hit.select("id", F.col("names.primary").alias("name"), F.col("categories.primary").alias(
        "category"), F.col("categories.alternate").alias("alternates"),
        F.round("confidence", 3).alias("confidence"), wkb_point("geometry").alias("_p"))
    pts = flat.select("*", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")).drop("_p")
    tiled = spatial_join(pts.withColumn("_all", F.lit(0)), districts.withColumn("_all", F.lit(0)),
                         ["district_id"], keys=("_all",)).drop("_all")
    return tiled.withColumn("program", bucket_with_alternates("category", "alternates"))


GEOJSON = ("type string, features array<struct<type:string, properties:map<string,string>, "
           "geometry:struct<type:string, coordinates:string>>>")
COORDS = "array<array<array<double>>>"


def read_layer(spark: SparkSession, path: str, kinds: list[str], keep: list[str],
               multiline: bool = False) -> DataFrame:
    """Vector features as one row per polygon part with the listed properties.

    Reads feature collections, one document per line (splittable) or per file. A third
    coordinate is dropped.
    """
    docs = spark.read.schema(GEOJSON).option("multiLine", multiline).json(path)
    f = docs.select(F.explode("features").alias("f")).where(F.col("f.geometry.type").isin(kinds))
    text = F.col("f.geometry.coordinates")
    multi = F.from_json(text, f"array<{COORDS}>")
    single = F.from_json(text, COORDS)
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).otherwise(F.array(single))
    props = [F.try_element_at("f.properties", F.lit(p)).alias(p) for p in keep]
    rows = f.select(*props, F.posexplode(parts).alias("part_no", "c"))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return rows.select(*keep, "part_no", F.transform("c", ring).alias("rings"))


def read_gtfs(spark: SparkSession, path: str, table: str) -> DataFrame:
    """S3: one table of all feeds; every column is text, feed_id comes from the folder.

    Header names lose a byte-order mark and surrounding blanks. Files are read by their own
    header: those with the same one together, the others apart, then merged by name.
    """
    clean = lambda c: c.replace("﻿", "").strip()
    files = spark.read.format("binaryFile").load(f"{path}/{table}").where("length > 0").select("path").collect()
    groups: dict[str, list[str]] = {}
    for f in sorted(r.path for r in files):
        groups.setdefault(spark.read.text(f).first()[0], []).append(f)
    feeds = []
    for same in groups.values():
        df = spark.read.option("header", True).option("inferSchema", False).option(
            "basePath", f"{path}/{table}").csv(same)
        feeds.append(df.select(*[F.col(f"`{c}`").cast("string").alias(clean(c)) for c in df.columns]))
    return merge_feeds(feeds)


def merge_feeds(feeds: list[DataFrame]) -> DataFrame:
    """S3: feeds with different optional columns under one schema."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped job counts; the block code is text of fifteen digits."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.lpad("w_geocode", 15, "0").alias("w_geocode"), *[
        F.col(c).try_cast("double").alias(c) for c in df.columns if c != "w_geocode"])


def read_acs(spark: SparkSession, path: str) -> DataFrame:
    """Array-of-arrays responses, the first inner array naming the columns.

    Adds the twelve-digit unit code, renames variables and turns sentinel codes into NULL.
    """
    rows = spark.read.text(path).select(F.from_json("value", "array<array<string>>").alias("a"))
    one = rows.select(F.col("a")[0].alias("h"), F.explode(F.slice(
        "a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0)))).alias("r"))
    m = one.select(F.map_from_arrays("h", "r").alias("m"))
    get = lambda c: F.try_element_at("m", F.lit(c))
    code = F.concat(F.lpad(get("state"), 2, "0"), F.lpad(get("county"), 3, "0"),
                    F.lpad(get("tract"), 6, "0"), get("block group"))
    return m.select(code.alias("geoid"), *[null_if_sentinel(get(v).try_cast("double")).alias(n)
                                           for v, n in V.ACS_VARIABLES.items()])


def available_variables(spark: SparkSession, years: list[int]) -> DataFrame:
    """Variables that exist in each vintage."""
    rows = [(y, v, n) for y in years for v, n in V.ACS_VARIABLES.items()
            if y >= V.ACS_FIRST_YEAR.get(v, V.ACS_FIRST_YEAR_DEFAULT)]
    return spark.createDataFrame(rows, "yr int, variable string, name string")


def restrict_to_vintage(df: DataFrame, year: str, names: list[str]) -> DataFrame:
    """Columns that did not exist in the row's vintage become NULL."""
    first = {n: V.ACS_FIRST_YEAR.get(v, V.ACS_FIRST_YEAR_DEFAULT) for v, n in V.ACS_VARIABLES.items()}
    return df.select(*[c for c in df.columns if c not in names], *[
        F.when(F.col(year) >= first[n], F.col(n)).alias(n) for n in names])


def merge_labels(basic: DataFrame, rich: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two label sheets joined by name, the richer one first; and rows with a problem."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = rich.where(blank("primary_typology").isNotNull()).select(
        "name", blank("primary_typology").alias("_p"), blank("secondary_typology").alias("_s"),
        blank("notes").alias("_n"))
    m = basic.join(r, "name", "left").select(
        "district_id", "name", canonical_typology(F.coalesce("_p", blank("primary_typology")))
        .alias("primary_typology"), canonical_typology("_s").alias("secondary_typology"),
        F.coalesce("_n", blank("notes")).alias("notes"), F.col("_p").isNotNull().alias("in_both"))
    known = m["primary_typology"].isin(V.TYPOLOGIES)
    bad = m.where(~F.coalesce(known, F.lit(False))).select("district_id", F.when(
        F.col("primary_typology").isNull(), "missing").otherwise("unrecognised").alias("warning"))
    return m, bad


def registry(districts: DataFrame, code: str = "code") -> DataFrame:
    """Number, name, place and country basis parsed from the district code."""
    from townloom.functions.classify import is_canadian

    part = F.split(F.col(code), "_")
    return districts.select(
        "district_id", code, F.regexp_extract(code, r"^(\d+)_", 1).try_cast("int").alias("number"),
        F.regexp_extract(code, r"-([A-Z]{2})$", 1).alias("state"),
        F.replace(F.regexp_replace(F.try_element_at(part, F.size(part)), r"-[A-Z]{2}$", ""),
                  F.lit("-"), F.lit(" ")).alias("place"),
        F.when(is_canadian(code), "needs-statcan").otherwise("us-census").alias("census_basis"))
