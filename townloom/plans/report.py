"""The flagship plan: program mix, contrast, most similar districts and typology fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.operators import programs, spatial
from townloom.operators import similarity as sim
from townloom.session import cut


def district_report(L) -> DataFrame:
    """One row per district. The zoned places are reduced to counts per (zone, program) once;
    everything after that works on those few rows per district."""
    placed = spatial.assign_zone(L.places(), L.boundaries())
    counts = cut(placed.groupBy("district_id", "zone", "program").agg(F.count("*").alias("n")))
    inside = F.col("zone") == "interior"
    base = counts.groupBy("district_id").agg(
        F.sum("n").alias("n_places"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("inside_n"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("_e"),
        *[F.sum(F.when(inside & (F.col("program") == "retail_food_entertainment"), F.col("n"))
                .otherwise(0)).alias("_ri"),
          F.sum(F.when(~inside & (F.col("program") == "retail_food_entertainment"), F.col("n"))
                .otherwise(0)).alias("_re")],
        *[(F.sum(F.when(F.col("program") == b, F.col("n")).otherwise(0)) / F.sum("n")).alias(b)
          for b in V.BUCKETS])
    pct = lambda part, whole: F.coalesce(F.round(100.0 * F.try_divide(part, whole), 2), F.lit(0.0))
    top = F.array_min(F.array(*[F.struct((-F.col(b)).alias("v"), F.lit(b).alias("b"))
                                for b in V.BUCKETS]))
    near = cut(sim.rank_shares(base.select("district_id", *V.BUCKETS), "district_id", V.BUCKETS, 7))
    d = L.view("districts")
    labels = d.select("district_id", F.when(F.col("district_id") % 8 != 5, F.col("typology"))
                      .alias("primary"), "secondary", F.col("typology").alias("fallback"))
    fit = sim.typology_fit(near, labels, "district_id", V.TYPOLOGIES)
    similar = near.where("rank <= 5").groupBy("id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "neighbor"))),
        lambda s: s["neighbor"].cast("string")), ",").alias("similar"))
    return (base.join(similar, base["district_id"] == similar["id"]).drop("id")
            .join(fit, F.col("district_id") == fit["id"])
            .select("district_id", "n_places", "inside_n",
                    (pct("_ri", "inside_n") - pct("_re", "_e")).alias("retail_difference"),
                    top["b"].alias("top_program"), "similar", "top_type"))
