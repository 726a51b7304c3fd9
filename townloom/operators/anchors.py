"""Anchor measures: polar cells, face carpets, transects and archetypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.functions.shapes import simplify_rings
from townloom.operators.spatial import KEYS, spatial_join


def polar_cells(anchors: DataFrame, places: DataFrame, anchor_id: str, rings_ft=(100, 250, 500),
                keys=KEYS) -> DataFrame:
    """Dominant program and count per compass sector and distance ring.

    The ring follows the distance to the footprint edge, the sector the bearing from its centre.
    """
    outer = [r * V.M_PER_FT for r in rings_ft]
    near = spatial_join(places.select(*keys, "x", "y", "program"), anchors, [anchor_id, "cx", "cy"],
                        within=outer[-1], keys=keys, distance_as="edge_m")
    ring = F.lit(None).cast("int")
    for i in range(len(outer) - 1, -1, -1):
        ring = F.when(F.col("edge_m") <= outer[i], i).otherwise(ring)
    n = near.withColumn("sector", geo.sector(geo.bearing("cx", "cy", "x", "y"))).withColumn(
        "ring", ring).groupBy(*keys, anchor_id, "sector", "ring", "program").agg(F.count("*").alias("n"))
    return n.groupBy(*keys, anchor_id, "sector", "ring").agg(
        F.min_by("program", F.struct(-F.col("n"), "program")).alias("dominant_program"),
        F.sum("n").alias("count"))


def archetype(anchors: DataFrame, cells: DataFrame, anchor_id: str, keys=KEYS) -> DataFrame:
    """A name for each anchor from the sectors it faces and its strongest program."""
    k = [*keys, anchor_id]
    sectors = cells.select(*k, "sector").distinct().groupBy(*k).agg(F.count("*").alias("_s"))
    p = cells.groupBy(*k, "dominant_program").agg(F.sum("count").alias("_n"))
    t = p.groupBy(*k).agg(F.min_by("dominant_program", F.struct(-F.col("_n"), "dominant_program"))
                          .alias("_p"), F.max("_n").alias("_m"), F.sum("_n").alias("_t"))
    share = F.col("_m") / F.col("_t")
    say = lambda a, b="": F.concat(F.lit(a), F.col("_p"), F.lit(b))
    name = (F.when(F.col("_t").isNull(), "morphological false positive")
            .when(F.col("_s") <= 2, say("asymmetric (", ")"))
            .when((F.col("_s") >= 6) & (share >= 0.55), say("distributed "))
            .when((F.col("_p") == "office") & (share > 0.5), "office tower")
            .when((F.col("_p") == "retail_food_entertainment") & (share > 0.5), "retail-front anchor")
            .when(F.col("_p") == "sport", "asymmetric stadium").otherwise(say("mixed-use (", " dom.)")))
    return (anchors.select(*k).join(sectors, k, "left").join(t, k, "left")
            .select(*k, name.alias("archetype")))


def face_carpet(anchors: DataFrame, places: DataFrame, anchor_id: str, radius: float = 100.0,
                tolerance: float = 3.0, keys=KEYS) -> DataFrame:
    """Places around each anchor, assigned to the faces of its simplified outline.

    A place belongs to the face whose stretch of the original outline holds its nearest point;
    the last face wraps through the start of the outline.
    """
    k = [*keys, anchor_id]
    ring = anchors.select(*k, F.col("rings")[0].alias("ring"))
    line = ring.withColumn("_l", simplify_rings(tolerance)("ring"))
    face = line.select(*k, "ring", F.posexplode(geo.segments("_l")).alias("face", "s"))
    face = face.select(
        *k, "face", geo.segment_length(F.col("s")).alias("length_m"),
        geo.bearing(F.col("s.x1"), F.col("s.y1"), F.col("s.x2"), F.col("s.y2")).alias("bearing_deg"),
        geo.arc_position("ring", F.col("s.x1"), F.col("s.y1")).alias("arc_start"),
        geo.arc_position("ring", F.col("s.x2"), F.col("s.y2")).alias("arc_end"))
    hits = spatial_join(places.select(*keys, "x", "y", "program"), anchors, [anchor_id, "rings"],
                        within=radius, keys=keys)
    hits = hits.select(*k, "program", geo.arc_position(F.col("rings")[0], "x", "y").alias("arc"))
    a, s, e = F.col("arc"), F.col("arc_start"), F.col("arc_end")
    on = F.when(e < s, (a >= s) | (a <= e)).otherwise((a >= s) & (a <= e))
    n = hits.join(face.select(*k, "face", "arc_start", "arc_end"), k).where(on).groupBy(
        *k, "face", "program").agg(F.count("*").alias("n"))
    c = n.groupBy(*k, "face").agg(F.sum("n").alias("poi_count"), F.min_by(
        "program", F.struct(-F.col("n"), "program")).alias("dominant_program"))
    return (face.join(c, [*k, "face"], "left").fillna(0, ["poi_count"])
            .withColumn("compass", geo.compass(geo.sector("bearing_deg")))
            .withColumn("poi_density_per_m", F.round(F.coalesce(F.try_divide(
                "poi_count", "length_m"), F.lit(0.0)), 4)))


def transect_range(boundaries: DataFrame, axes: DataFrame, half: float, keys=KEYS,
                   pad: float = V.AXIS_END_BUFFER_M) -> DataFrame:
    """Stretch of each district's axis inside its boundary, padded and kept on the canvas.

    `axes` has ax, ay and axis_deg. Positions are measured from (ax, ay); the canvas reaches
    `half` metres along the axis both ways. The longest stretch counts.
    """
    b = boundaries.select(*keys, geo.edges("rings").alias("_e")).join(axes, list(keys))
    at = lambda x, y: geo.axis_position("ax", "ay", "axis_deg", x, y)
    ends = F.transform("_e", lambda s: F.struct(at(s["x1"], s["y1"]).alias("p"),
                                                at(s["x2"], s["y2"]).alias("q")))
    cross = F.filter(ends, lambda d: (d["p"]["perp"] > 0) != (d["q"]["perp"] > 0))
    cuts = F.array_sort(F.transform(cross, lambda d: d["p"]["s"] + (d["q"]["s"] - d["p"]["s"])
                                    * d["p"]["perp"] / (d["p"]["perp"] - d["q"]["perp"])))
    best = geo.let(cuts, lambda v: F.when(F.size(v) >= 2, F.array_max(F.transform(
        F.sequence(F.lit(0), F.size(v) - 2, F.lit(2)), lambda i: F.struct(
            (F.get(v, i + 1) - F.get(v, i)).alias("w"), F.get(v, i).alias("a"),
            F.get(v, i + 1).alias("z"))))))
    r = b.select(*keys, "ax", "ay", "axis_deg", best.alias("_r"))
    return r.select(*keys, "ax", "ay", "axis_deg",
                    F.greatest(F.coalesce(F.col("_r.a") - pad, F.lit(-half)), F.lit(-half)).alias("s_min"),
                    F.least(F.coalesce(F.col("_r.z") + pad, F.lit(half)), F.lit(half)).alias("s_max"))


def transect(places: DataFrame, ranges: DataFrame, width: float, bin_m: float = 50.0, keys=KEYS
             ) -> DataFrame:
    """Places along the axis per bin and side, within a width of it."""
    p = places.join(ranges, list(keys)).withColumn(
        "_p", geo.axis_position("ax", "ay", "axis_deg", "x", "y"))
    keep = (F.col("_p.s").between(F.col("s_min"), F.col("s_max"))) & (F.abs(F.col("_p.perp")) <= width)
    return p.where(keep).groupBy(
        *keys, F.floor((F.col("_p.s") - F.col("s_min")) / bin_m).cast("int").alias("bin"),
        F.when(F.col("_p.perp") >= 0, "left").otherwise("right").alias("side"), "program").agg(
        F.count("*").alias("n"))
