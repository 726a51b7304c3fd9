"""District feature rows, comparison records and node features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import num
from townloom.functions import vocab as V
from townloom.operators.ranks import quantiles
from townloom.operators.spatial import KEYS


def assemble(districts: DataFrame, bands: list[DataFrame], keys=KEYS) -> DataFrame:
    """M1: one wide row per district; a band that is missing leaves NULLs."""
    out = districts
    for band in bands:
        out = out.join(band, list(keys), "left")
    return out


def program_band(contrast: DataFrame, keys=KEYS) -> DataFrame:
    """M1: interior bucket percentages and their entropy from the interior / exterior table."""
    pos = F.when(F.col("interior_pct") > 0, F.col("interior_pct"))
    total = contrast.groupBy(*keys).agg(F.sum(pos).alias("_t"))
    p = pos / F.col("_t")
    return contrast.join(total, list(keys)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("program") == b, F.col("interior_pct"))).alias(f"prog_pct_{b}")
          for b in V.BUCKETS],
        F.coalesce(F.sum(-p * F.log(p + F.lit(1e-12))), F.lit(0.0)).alias("prog_diversity"))


def demographic_band(units: DataFrame, weight: str, area_km2: DataFrame, keys=KEYS) -> DataFrame:
    """M1: people of the district's interior: overlap-weighted units, 0 where nothing is known."""
    from townloom.functions.num import null_if_sentinel

    w = F.coalesce(F.col(weight), F.lit(0.0))
    total = lambda c: F.sum(F.coalesce(null_if_sentinel(c), F.lit(0.0)) * w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda part, whole: zero(F.try_divide(part, whole)) * 100.0

    def mean(c):
        people, v = F.coalesce(F.col("total_pop"), F.lit(0.0)) * w, null_if_sentinel(c)
        ok = v.isNotNull() & (people > 0)
        return zero(F.try_divide(F.sum(F.when(ok, v * people)), F.sum(F.when(ok, people))))

    races = ["race_white", "race_black", "race_asian", "hispanic"]
    sums = units.where(w > 0).groupBy(*keys).agg(
        total("total_pop").alias("_pop"), mean("median_age").alias("demo_median_age"),
        mean("median_household_income").alias("demo_median_hh_income"), mean("median_home_value").alias("demo_median_home_value"),
        share(sum([total(f"edu_{x}") for x in ("masters", "professional", "doctorate")], total("edu_bachelors")),
              total("edu_total_pop_25plus")).alias("demo_pct_bachelors_plus"),
        share(total("unemployed"), total("labor_force")).alias("demo_unemployment_rate"),
        share(total("owner_occupied"), total("occupied_total")).alias("demo_pct_owner_occupied"),
        *[total(r).alias(f"_{r}") for r in races], total("race_total").alias("_all"))
    other = F.greatest(F.lit(0.0), F.col("_all") - F.col("_race_white") - F.col("_race_black") - F.col("_race_asian"))
    groups = F.filter(F.array(*[F.col(f"_{r}") for r in races], other), lambda v: v > 0)
    whole = F.aggregate(groups, F.lit(0.0), lambda a, v: a + v)
    entropy = F.aggregate(F.transform(groups, lambda v: v / whole), F.lit(0.0), lambda a, p: a - p * F.log(p + F.lit(1e-12)))
    a = F.col("area_km2")
    return sums.join(area_km2.select(*keys, "area_km2"), list(keys), "left").select(
        *keys, zero(F.try_divide(F.col("_pop"), a)).alias("demo_population_density"), "demo_median_age", "demo_median_hh_income",
        "demo_median_home_value", "demo_pct_bachelors_plus", "demo_unemployment_rate", "demo_pct_owner_occupied",
        entropy.alias("demo_racial_diversity"))


def scale_band(inside: DataFrame, area_km2: DataFrame, keys=KEYS) -> DataFrame:
    """M1: size of the district and number of footprints inside."""
    n = inside.groupBy(*keys).agg(F.count("*").alias("buildings_inside_count"))
    return area_km2.select(*keys, F.col("area_km2").alias("sad_area_km2")).join(n, list(keys), "left").fillna(
        0, ["buildings_inside_count"])


def residential_footprint(inside: DataFrame, tag: str, keys=KEYS) -> DataFrame:
    """M1: residential share of the built area, which replaces the share of residential places."""
    homes = F.sum(F.when(F.col(tag).isin(V.RESIDENTIAL_BUILDING_TAGS), F.col("area_m2")).otherwise(0.0))
    return inside.groupBy(*keys).agg((100.0 * homes / F.sum("area_m2")).alias("prog_pct_residential"))


def connectivity(area: DataFrame, stations: DataFrame, service: DataFrame, walk: DataFrame,
                 streets: DataFrame, keys=KEYS) -> DataFrame:
    """Transit, walking and street measures per district, by area where they are counts."""
    k = list(keys)
    j = area
    for part in (stations, service, walk, streets):
        j = j.join(part, k, "left")
    a = F.when(F.col("area_km2") > 0, F.col("area_km2")).otherwise(1.0)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    per = lambda c: F.coalesce(F.col(c) / a, F.lit(0.0))
    return j.select(
        *k, per("total_stations").alias("conn_stations_per_km2"),
        zero("routes_serving").alias("conn_routes_serving"),
        zero("trips_per_day").alias("conn_trips_per_day"),
        F.coalesce(F.when(F.col("median_route_headway_min") > 0,
                          60.0 / F.col("median_route_headway_min")), F.lit(0.0)).alias("conn_headway_inv"),
        zero("span_hours").alias("conn_span_hours"), zero("stops_in_buffer").alias("conn_stops_in_buffer"),
        F.coalesce(F.try_divide("stops_inside", "stops_in_buffer"), F.lit(0.0)).alias(
            "conn_stops_inside_ratio"),
        zero("walk_area").alias("conn_walkshed_area"),
        zero("mean_centrality_nonzero").alias("conn_street_mean_centrality"),
        per("feature_count").alias("conn_street_density"))


def node_features(enriched: DataFrame, shape: list[str], demographics: list[str]) -> DataFrame:
    """Raw node features of footprints: shape, program inside and near, people, zone."""
    def mix(c, prefix):
        total = F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, v: a + v)
        return [F.coalesce(F.try_divide(F.try_element_at(c, F.lit(b)), total), F.lit(0.0))
                .alias(f"{prefix}__{b}") for b in V.BUCKETS]

    def shaped(c):
        if c in V.SIZE_FEATURES:
            return num.log_size(c)
        if c in V.HU_FEATURES:
            # beyond 12 digits a moment is rounding noise of a symmetric shape
            return F.when(F.abs(F.col(c)) > 12, 0.0).otherwise(num.signed_log(c))
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    present = F.lit(False)
    for c in demographics:
        present = present | F.col(c).isNotNull()
    people = [(F.coalesce(F.col(c), F.lit(0.0)) if c == "median_age" else num.log_size(c))
              .alias(f"demo__{c}") for c in demographics]
    return enriched.select(
        "district_id", "building_id", *[shaped(c).alias(f"shape__{c}") for c in shape],
        *mix("programs_inside", "prog"), F.log1p("place_count_inside").alias("prog__count_inside_log"),
        *mix("programs_adjacent", "prog_adj"),
        F.log1p("place_count_adjacent").alias("prog_adj__count_adjacent_log"), *people,
        present.cast("double").alias("demo__present"),
        (F.col("zone") == "interior").cast("double").alias("zone__interior"))


def comparison_record(districts: DataFrame, buildings: DataFrame, anchors: DataFrame, keys=KEYS
                      ) -> DataFrame:
    """The flat record districts are compared by."""
    k = list(keys)
    n = buildings.groupBy(*k).agg(F.count("*").alias("building_count"))
    med = quantiles(buildings, k, "area_m2", {"median_area_m2": 0.5})
    a = anchors.groupBy(*k).agg(F.count("*").alias("anchor_count"),
                                F.max("area_m2").alias("max_anchor_area_m2"))
    return (districts.select(*k, "code", "typology").join(n, k).join(med, k).join(a, k, "left")
            .fillna(0, ["anchor_count", "max_anchor_area_m2"]))


def thematic_axes(features: DataFrame, charts: dict[str, tuple[str, str]], keys=KEYS) -> DataFrame:
    """X and y of each thematic chart as rows."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("chart"), F.col(x).alias("x"), F.col(y).alias("y"))
                               for n, (x, y) in charts.items()]))
    return features.select(*keys, rows.alias("_c")).select("_c.chart", *keys, "_c.x", "_c.y")


def comparison_board(neighbours: DataFrame, enriched: DataFrame) -> DataFrame:
    """A site with its comparables: footprints, median area, coverage and top programs."""
    k = "district_id"
    n = enriched.groupBy(k).agg(F.count("*").alias("n_buildings"), F.avg(
        (F.col("place_count_inside") > 0).cast("int")).alias("cov"))
    med = quantiles(enriched, [k], "area_m2", {"med": 0.5})
    prog = enriched.select(k, F.explode("programs_inside").alias("program", "_n")).groupBy(
        k, "program").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(k).orderBy(F.desc("_n"), "program")
    top = prog.withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy(k).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "program"))), lambda s: s["program"]),
        ",").alias("top3"))
    stats = n.join(med, k).join(top, k, "left")
    members = neighbours.select("id", F.col("neighbor").alias(k), F.lit("comparable").alias("role")
                                ).unionByName(neighbours.select("id").distinct().select(
                                    "id", F.col("id").alias(k), F.lit("site").alias("role")))
    return members.join(stats, k).withColumnRenamed(k, "member")


def site_facts(districts: DataFrame, facts: DataFrame, keys=KEYS) -> DataFrame:
    """Sparse facts joined to districts; what is unknown stays NULL."""
    return districts.select(*keys).join(facts, list(keys), "left")
