"""Writers for summaries and web tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.functions.shapes import simplify_rings
from townloom.operators.spatial import KEYS


def write_summaries(df: DataFrame, path: str, key: str = "district_id", as_json: bool = False) -> None:
    """One folder per district as Parquet, or one JSON document per row.

    Rows of a district are brought together first, so a folder gets few files.
    """
    if as_json:
        df.select(key, F.to_json(F.struct(*df.columns)).alias("value")).repartition(key).write.mode(
            "overwrite").partitionBy(key).text(path)
    else:
        df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def replace_districts(df: DataFrame, path: str, key: str = "district_id") -> None:
    """Overwrite only the folders of the districts present in the frame."""
    (df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


def thumbnails(footprints: DataFrame, ident: str, keys=KEYS) -> DataFrame:
    """Outlines on a 0-1000 grid per district, small ones dropped, ranked by area.

    All others are returned; `drawn` marks those that a picture of limited size would show.

    The y axis points down. Coordinates are whole numbers.
    """
    k = list(keys)
    ring = F.col("rings")[0]
    box = footprints.select(*k, geo.bbox("rings").alias("b")).groupBy(*k).agg(
        F.min("b.xmin").alias("_x0"), F.min("b.ymin").alias("_y0"), F.max("b.xmax").alias("_x1"),
        F.max("b.ymax").alias("_y1"))
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1e-9)
    d = footprints.select(*k, ident, ring.alias("ring")).join(box, k).withColumn(
        "ring", F.transform("ring", lambda p: F.struct(
            ((p["x"] - F.col("_x0")) / span("_x0", "_x1") * 1000).alias("x"),
            ((1 - (p["y"] - F.col("_y0")) / span("_y0", "_y1")) * 1000).alias("y"))))
    d = d.select(*k, ident, simplify_rings(V.THUMBNAIL_SIMPLIFY)("ring").alias("ring")).withColumn(
        "_a", geo.ring_area("ring"))
    d = d.where((F.size("ring") >= 4) & (F.col("_a") >= 1e6 * V.THUMBNAIL_MIN_AREA_FRACTION))
    w = Window.partitionBy(*k).orderBy(F.desc("_a"), ident)
    whole = F.transform("ring", lambda p: F.struct(F.round(p["x"]).cast("int").alias("x"),
                                                   F.round(p["y"]).cast("int").alias("y")))
    return d.withColumn("_r", F.row_number().over(w)).select(
        *k, ident, whole.alias("ring"), F.col("_r").alias("rank"), (F.col("_r") <= V.THUMBNAIL_MAX_RINGS).alias("drawn"))
