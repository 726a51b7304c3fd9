"""Program, structure and footprint summaries per district."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.operators.ranks import quantiles
from townloom.operators.spatial import KEYS, spatial_join


def bucket_dimension(df: DataFrame, buckets=V.BUCKETS, name: str = "program") -> DataFrame:
    """The fixed bucket list as a small broadcast table."""
    rows = [(i, b) for i, b in enumerate(buckets)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, f"bucket_no int, {name} string"))


def shares(df: DataFrame, keys: list[str], label: str, weight: Column | None = None,
           digits: int | None = 2) -> DataFrame:
    """A1: count (or weight) and percentage of each label within its group.

    Two aggregation levels; no window over the rows.
    """
    counted = df.groupBy(*keys, label).agg(
        (F.count("*") if weight is None else F.sum(weight)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("_t"))
    pct = F.try_divide(100.0 * F.col("n"), F.col("_t"))
    return counted.join(total, keys).withColumn(
        "pct", pct if digits is None else F.round(pct, digits)).drop("_t")


def zone_shares(places: DataFrame, keys=KEYS) -> DataFrame:
    """A1: bucket shares overall and per zone, in one pass over the rows."""
    counted = places.groupBy(*keys, "zone", "program").agg(F.count("*").alias("n"))
    both = counted.unionByName(counted.groupBy(*keys, "program").agg(F.sum("n").alias("n"))
                               .withColumn("zone", F.lit("all")))
    total = both.groupBy(*keys, "zone").agg(F.sum("n").alias("_t"))
    return both.join(total, [*keys, "zone"]).withColumn(
        "pct", F.round(100.0 * F.col("n") / F.col("_t"), 2)).drop("_t")


def interior_exterior(places: DataFrame, keys=KEYS) -> DataFrame:
    """A2: interior minus exterior share per bucket; a bucket that is absent counts 0."""
    inside = F.col("zone") == "interior"
    counted = places.groupBy(*keys, "program").agg(
        F.count(F.when(inside, 1)).alias("_i"), F.count(F.when(~inside, 1)).alias("_e"))
    total = counted.groupBy(*keys).agg(F.sum("_i").alias("_ti"), F.sum("_e").alias("_te"))
    grid = total.crossJoin(bucket_dimension(places))
    pct = lambda part, whole: F.coalesce(F.round(
        100.0 * F.try_divide(F.coalesce(F.col(part), F.lit(0)), F.col(whole)), 2), F.lit(0.0))
    return (grid.join(counted, [*keys, "program"], "left")
            .select(*keys, "program", pct("_i", "_ti").alias("interior_pct"),
                    pct("_e", "_te").alias("exterior_pct"))
            .withColumn("difference", F.col("interior_pct") - F.col("exterior_pct")))


def building_programs(buildings: DataFrame, places: DataFrame, adjacency_m: float = 10.0,
                      keys=KEYS) -> DataFrame:
    """A3: places inside and within reach of each footprint, with the dominant program.

    Programs come as a count per bucket, so a footprint holding very many places stays one
    small map; the sorted list of the reference's shape is `programs_inside`.
    """
    def counted(within):
        hits = spatial_join(places.select(*keys, "place_id", "x", "y", "program"), buildings,
                            ["building_id"], within=within, keys=keys)
        return hits.groupBy(*keys, "building_id", "program").agg(F.count("*").alias("n"))

    inside = counted(None).groupBy(*keys, "building_id").agg(
        F.sum("n").alias("place_count_inside"),
        F.array_sort(F.collect_list(F.struct("program", "n"))).alias("_pi"),
        F.min_by("program", F.struct(-F.col("n"), "program")).alias("dominant_program_inside"))
    near = counted(adjacency_m).groupBy(*keys, "building_id").agg(
        F.sum("n").alias("place_count_adjacent"),
        F.array_sort(F.collect_list(F.struct("program", "n"))).alias("_pa"))
    to_map = lambda c: F.coalesce(F.map_from_entries(c),
                                  F.create_map().cast("map<string,bigint>"))
    return (buildings.join(inside, [*keys, "building_id"], "left")
            .join(near, [*keys, "building_id"], "left")
            .withColumn("programs_inside", to_map(F.col("_pi")))
            .withColumn("programs_adjacent", to_map(F.col("_pa")))
            .drop("_pi", "_pa").fillna(0, ["place_count_inside", "place_count_adjacent"]))


def cluster_crosstab(enriched: DataFrame, keys=KEYS) -> DataFrame:
    """A4: bucket shares of the places inside each footprint cluster, with sizes and medians."""
    base = enriched.where(F.col("cluster_id") > 0)
    one = lambda b: F.coalesce(F.try_element_at("programs_inside", F.lit(b)), F.lit(0))
    sums = base.groupBy(*keys, "cluster_id").agg(
        F.count("*").alias("n_buildings"),
        F.count(F.when(F.col("place_count_inside") > 0, 1)).alias("buildings_with_programs"),
        *[F.sum(one(b)).alias(f"n_{b}") for b in V.BUCKETS])
    total = sum([F.col(f"n_{b}") for b in V.BUCKETS[1:]], F.col(f"n_{V.BUCKETS[0]}"))
    pairs = F.array(*[F.struct((-F.col(f"n_{b}")).alias("n"), F.lit(i).alias("i"),
                               F.lit(b).alias("b")) for i, b in enumerate(V.BUCKETS)])
    med = quantiles(base, [*keys, "cluster_id"], "area_m2", {"median_area_m2": 0.5})
    return (sums.withColumn("n_programs_inside", total)
            .withColumn("dominant_program", F.when(F.col("n_programs_inside") > 0,
                                                   F.array_min(pairs)["b"]))
            .select(*keys, "cluster_id", "n_buildings", "buildings_with_programs",
                    "n_programs_inside", "dominant_program",
                    *[F.round(F.coalesce(F.try_divide(F.col(f"n_{b}"), F.col("n_programs_inside")),
                                         F.lit(0.0)), 4).alias(f"pct_{b}") for b in V.BUCKETS])
            .join(med, [*keys, "cluster_id"]))


def structure_shares(structures: DataFrame, keys=KEYS) -> DataFrame:
    """Floor-area and count shares per structure bucket; sqft that is missing is counted."""
    area = F.when(F.col("sqft") > 0, F.col("sqft"))
    by = structures.groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(area, F.lit(0.0))).alias("sqft"),
        F.count(F.when(area.isNull(), 1)).alias("missing"))
    total = by.groupBy(*keys).agg(F.sum("n").alias("n_structures"),
                                  F.sum("sqft").alias("total_sqft"),
                                  F.sum("missing").alias("missing_sqft"))
    grid = total.crossJoin(bucket_dimension(structures, V.STRUCTURE_BUCKETS, "bucket"))
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(
        F.coalesce(F.col(part), F.lit(0)), F.col(whole)), F.lit(0.0)), 4)
    return grid.join(by, [*keys, "bucket"], "left").select(
        *keys, "bucket", F.coalesce("n", F.lit(0)).alias("n"),
        share("sqft", "total_sqft").alias("share_sqft"),
        share("n", "n_structures").alias("share_count"), "n_structures", "total_sqft",
        "missing_sqft",
        F.when(F.col("total_sqft") > 0, share("sqft", "total_sqft"))
        .otherwise(share("n", "n_structures")).alias("share"))


def structure_gate(shares_table: DataFrame, keys=KEYS, min_structures: int = 5,
                   max_other: float = 0.5) -> DataFrame:
    """Districts whose structure read may stand for the program mix."""
    return shares_table.groupBy(*keys).agg(
        F.max("n_structures").alias("n_structures"), F.sum("share_sqft").alias("_sum"),
        F.sum(F.when(F.col("bucket") == "other", F.col("share_sqft"))).alias("other_share")
    ).withColumn("usable", (F.col("_sum") > 0) & (F.col("n_structures") >= min_structures)
                 & (F.col("other_share") < max_other)).drop("_sum")


def code_histogram(structures: DataFrame, keys=KEYS) -> DataFrame:
    """Structures per occupancy code, cut to eight characters."""
    code = F.substring(F.coalesce(F.nullif(F.col("occtype"), F.lit("")), F.lit("?")), 1, 8)
    return structures.groupBy(*keys, code.alias("code")).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, keys: list[str], label: str, weight: Column | None = None,
            eps: float = 0.0, name: str = "entropy") -> DataFrame:
    """A10: Shannon entropy (natural logarithm) of the label mix of each group."""
    counted = df.groupBy(*keys, label).agg(
        (F.count("*").cast("double") if weight is None else F.sum(weight)).alias("_n"))
    total = counted.where("_n > 0").groupBy(*keys).agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    return counted.where("_n > 0").join(total, keys).groupBy(*keys).agg(
        F.sum(-p * F.log(p + F.lit(eps))).alias(name))


def occupancy_mix(buildings: DataFrame, keys=KEYS) -> DataFrame:
    """Footprint-area share of nine occupancy groups and their entropy."""
    base = buildings.where(F.col("area_m2") > 0)
    mix = base.groupBy(*keys).agg(
        F.sum("area_m2").alias("_t"),
        *[F.sum(F.when(F.col("occupancy_group") == g, F.col("area_m2")).otherwise(0.0))
          .alias(f"_a{i}") for i, g in enumerate(V.OCCUPANCY_GROUPS)])
    parts = [F.col(f"_a{i}") / F.col("_t") for i in range(len(V.OCCUPANCY_GROUPS))]
    terms = [F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in parts]
    name = lambda g: "progocc_pct_" + g.replace("/", "_").replace(" ", "_")
    return mix.select(*keys, *[(100.0 * p).alias(name(g))
                               for g, p in zip(V.OCCUPANCY_GROUPS, parts)],
                      sum(terms[1:], terms[0]).alias("progocc_diversity"))


def axial_concentration(angle_deg) -> Column:
    """Rayleigh R of angles modulo 180 as an aggregate (double-angle method)."""
    a = F.radians(F.pmod(F.col(angle_deg) if isinstance(angle_deg, str) else angle_deg,
                         F.lit(180.0)) * 2.0)
    cos, sin = F.avg(F.cos(a)), F.avg(F.sin(a))
    return F.sqrt(cos * cos + sin * sin)


def morphology(inside: DataFrame, district_area: DataFrame, keys=KEYS) -> DataFrame:
    """Eight form measures of the footprints inside each district.

    `inside` has area_m2, perimeter_m, orientation_deg, cluster_id; `district_area` has area_m2.
    """
    ok = (F.col("perimeter_m") > 0) & (F.col("area_m2") > 0)
    comp = F.when(ok, 4 * 3.141592653589793 * F.col("area_m2")
                  / (F.col("perimeter_m") * F.col("perimeter_m")))
    base = inside.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.sum("area_m2").alias("_area"),
        F.skewness(F.log1p("area_m2")).alias("_skew"), F.count("area_m2").alias("_na"),
        F.avg(comp).alias("morph_mean_compactness"),
        axial_concentration("orientation_deg").alias("morph_orientation_R"))
    q = quantiles(inside, list(keys), "area_m2", {"_q25": 0.25, "_q50": 0.5, "_q75": 0.75})
    h = entropy(inside, list(keys), "cluster_id", eps=1e-12, name="morph_cluster_diversity")
    d = district_area.select(*keys, F.col("area_m2").alias("_da"))
    j = (d.join(base, list(keys), "left").join(q, list(keys), "left").join(h, list(keys), "left"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        *keys,
        zero(F.try_divide(F.col("_n"), F.col("_da") / 1e6)).alias("morph_density_per_km2"),
        zero(F.try_divide(F.col("_area"), F.col("_da"))).alias("morph_coverage"),
        zero(F.col("_q50")).alias("morph_median_area_m2"),
        zero(F.col("_q75") - F.col("_q25")).alias("morph_area_iqr"),
        zero(F.when((F.col("_na") > 2) & ~F.isnan("_skew"), F.col("_skew"))).alias(
            "morph_area_log_skew"),
        zero(F.col("morph_mean_compactness")).alias("morph_mean_compactness"),
        zero(F.col("morph_orientation_R")).alias("morph_orientation_R"),
        zero(F.col("morph_cluster_diversity")).alias("morph_cluster_diversity"))


def anchor_features(anchors_inside: DataFrame, buildings_inside: DataFrame, districts: DataFrame,
                    keys=KEYS) -> DataFrame:
    """Anchors inside, share of the largest in all built area, top-1 over top-3 area."""
    w = Window.partitionBy(*keys).orderBy(F.desc("area_m2"), "building_id")
    top = (anchors_inside.withColumn("_r", F.row_number().over(w)).where("_r <= 3")
           .groupBy(*keys).agg(F.max("area_m2").alias("_top1"), F.sum("area_m2").alias("_top3")))
    n = anchors_inside.groupBy(*keys).agg(F.count("*").cast("double").alias("_n"))
    total = buildings_inside.groupBy(*keys).agg(F.sum("area_m2").alias("_t"))
    j = (districts.select(*keys).join(n, list(keys), "left").join(top, list(keys), "left")
         .join(total, list(keys), "left"))
    return j.select(*keys, F.coalesce("_n", F.lit(0.0)).alias("anchor_count_inside"),
                    F.coalesce(F.try_divide("_top1", F.coalesce("_t", F.lit(1.0))), F.lit(0.0))
                    .alias("anchor_max_area_ratio"),
                    F.coalesce(F.try_divide("_top1", "_top3"),
                               F.when(F.col("_n") > 0, 1.0).otherwise(0.0))
                    .alias("anchor_size_concentration"))


def anchor_cluster(buildings: DataFrame, keys=KEYS) -> DataFrame:
    """The cluster with the largest median area; ties take the smaller cluster."""
    med = quantiles(buildings, [*keys, "cluster_id"], "area_m2", {"_m": 0.5})
    return med.groupBy(*keys).agg(
        F.min_by("cluster_id", F.struct(-F.col("_m"), "cluster_id")).alias("anchor_cluster"),
        F.max("_m").alias("median_area_m2"))


def modal_orientation(buildings: DataFrame, keys=KEYS, bins: int = 36, boost: float = 10.0
                      ) -> DataFrame:
    """Centre of the heaviest of 36 direction bins; the anchor cluster weighs tenfold."""
    width = 180.0 / bins
    b = buildings.join(anchor_cluster(buildings, keys), list(keys))
    weight = F.col("area_m2") * F.when(F.col("cluster_id") == F.col("anchor_cluster"), boost
                                       ).otherwise(1.0)
    bin_no = F.least(F.floor(F.pmod("orientation_deg", F.lit(180.0)) / width), F.lit(bins - 1))
    hist = b.where(F.col("orientation_deg").isNotNull()).groupBy(
        *keys, bin_no.cast("int").alias("bin")).agg(F.sum(weight).alias("w"))
    best = F.min_by("bin", F.struct(-F.round("w", 6), "bin"))
    return hist.groupBy(*keys).agg(best.alias("bin")).select(
        *keys, ((F.col("bin") + 0.5) * width).alias("axis_deg"))


def building_quantiles(buildings: DataFrame, keys=KEYS) -> DataFrame:
    """Quartiles of footprint area and the number of footprints."""
    n = buildings.groupBy(*keys).agg(F.count("*").alias("n_buildings"))
    return n.join(quantiles(buildings, list(keys), "area_m2",
                            {"p25": 0.25, "median": 0.5, "p75": 0.75}), list(keys))


def category_summary(places: DataFrame, keys=KEYS) -> DataFrame:
    """Places per leaf category."""
    return places.groupBy(*keys, "leaf").agg(F.count("*").alias("n"))


def residential_audit(places: DataFrame, keys=KEYS) -> DataFrame:
    """Housing-like leaves per bucket they were filed under, with the rule that matched."""
    from townloom.functions.classify import residential_rule

    return (places.withColumn("rule", residential_rule("leaf")).where("rule <> ''")
            .groupBy(*keys, "program", "leaf", "rule").agg(
                F.count("*").alias("n"),
                F.count(F.when(F.col("zone") == "interior", 1)).alias("n_interior")))


def peer_medians(features: DataFrame, label: str, columns: list[str], min_peers: int = 3
                 ) -> DataFrame:
    """Median of every feature per label, where at least three districts have it."""
    long = features.where(F.col(label).isNotNull()).select(
        label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                            F.col(c).cast("double").alias("value"))
                                   for c in columns])).alias("_f")).select(label, "_f.*")
    n = long.where(F.col("value").isNotNull()).groupBy(label, "feature").agg(
        F.count("*").alias("n_peers"))
    return n.where(F.col("n_peers") >= min_peers).join(
        quantiles(long, [label, "feature"], "value", {"median": 0.5}), [label, "feature"])


def coverage_matrix(districts: DataFrame, artefacts: dict[str, DataFrame], keys=KEYS) -> DataFrame:
    """Which layers exist for each district."""
    out = districts.select(*keys)
    for name, layer in artefacts.items():
        out = out.join(layer.select(*keys).distinct().withColumn(f"has_{name}", F.lit(True)),
                       list(keys), "left").fillna(False, [f"has_{name}"])
    return out


def add_shape_measures(df: DataFrame) -> DataFrame:
    """Area, perimeter, equivalent diameter and box ratios of each footprint."""
    box = geo.bbox("rings")
    d = (df.withColumn("area_m2", geo.area("rings")).withColumn("perimeter_m", geo.perimeter("rings"))
         .withColumn("_w", box["xmax"] - box["xmin"]).withColumn("_h", box["ymax"] - box["ymin"]))
    pi = 3.141592653589793
    return (d.withColumn("equivalent_diameter_m", F.sqrt(4.0 * F.col("area_m2") / pi))
            .withColumn("compactness", 4 * pi * F.col("area_m2")
                        / (F.col("perimeter_m") * F.col("perimeter_m") + F.lit(1e-9)))
            .withColumn("solidity", F.col("area_m2") / (F.col("_w") * F.col("_h") + F.lit(1e-9)))
            .withColumn("bbox_elongation", F.greatest("_w", "_h")
                        / (F.least(F.col("_w"), F.col("_h")) + F.lit(1e-9)))
            .drop("_w", "_h"))


def add_hull_measures(df: DataFrame) -> DataFrame:
    """Hull ratios, smallest rectangle, diameter, vertices and Hu moments."""
    from townloom.functions.shapes import hull_measures

    d = df.withColumn("_h", hull_measures("rings")).withColumn("_hu", geo.hu_moments("rings"))
    half = lambda c: F.col(f"_h.{c}") / 2.0
    ecc = F.sqrt(F.lit(1.0) - F.pow(half("mrr_short_side_m") / F.greatest(
        half("mrr_long_side_m"), F.lit(1e-9)), F.lit(2.0)))
    return (d.withColumn("hull_ratio", F.col("area_m2") / (F.col("_h.hull_area") + F.lit(1e-9)))
            .withColumn("roughness", F.col("perimeter_m")
                        / (F.col("_h.hull_perimeter") + F.lit(1e-9)))
            .withColumn("mrr_long_side_m", F.col("_h.mrr_long_side_m"))
            .withColumn("mrr_short_side_m", F.col("_h.mrr_short_side_m"))
            .withColumn("mrr_elongation", F.col("_h.mrr_long_side_m") / F.col("_h.mrr_short_side_m"))
            .withColumn("orientation_deg", F.col("_h.orientation_deg"))
            .withColumn("eccentricity", ecc)
            .withColumn("max_diameter_m", F.col("_h.max_diameter_m"))
            .withColumn("vertex_count", F.col("_h.vertex_count"))
            .withColumns({f"hu_{i + 1}": F.col("_hu")[i] for i in range(7)}).drop("_h", "_hu"))


def largest_part(parts: DataFrame, ident: list[str]) -> DataFrame:
    """The largest polygon of each multipolygon (one row per part)."""
    d = parts.withColumn("_a", geo.area("rings"))
    w = Window.partitionBy(*ident).orderBy(F.desc("_a"), "part_no")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_a")


def cap_largest(df: DataFrame, ident: str, cap: int = V.CANVAS_MAX_BUILDINGS, keys=KEYS
                ) -> DataFrame:
    """Rank of every footprint by area, the total, and whether the canvas has room for it.

    Nothing is dropped: a canvas that draws only so many footprints filters on `drawn`.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("total"))
    w = Window.partitionBy(*keys).orderBy(F.desc("area_m2"), ident)
    return (df.withColumn("area_rank", F.row_number().over(w)).withColumn("drawn", F.col("area_rank") <= cap)
            .join(n, list(keys)).withColumn("truncated", F.col("total") > cap))
