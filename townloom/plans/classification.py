"""Queries for scalar expressions and classifiers (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import classify as C
from townloom.functions import geo, num
from townloom.functions import vocab as V
from townloom.operators import programs
from townloom.plans.catalog import query
from townloom.plans.fixtures import LEAVES, pick, program_case


def quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def like_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def token_any(col: str, words) -> str:
    return (f"len(list_intersect(string_split_regex({col}, '[^a-z0-9]+'), "
            f"[{', '.join(repr(w) for w in words)}])) > 0")


def top_case(leaf: str) -> str:
    arms = []
    for family, words in V.TOP_LEVEL_KEYWORDS:
        cond = like_any(leaf, words)
        if family == "sports_and_recreation":
            cond = f"({cond} OR (contains({leaf}, 'sport') AND NOT contains({leaf}, 'passport')))"
        arms.append(f"WHEN {cond} THEN '{family}'")
    return f"(CASE {' '.join(arms)} END)"


def leaf_case(leaf: str) -> str:
    tops = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.TOP_LEVEL_BUCKET.items())
    return (f"(CASE WHEN {leaf} IN {quoted(V.PARKING_LEAVES)} THEN 'parking' "
            f"WHEN {leaf} IN {quoted(V.RESIDENTIAL_LEAVES)} THEN 'residential' "
            f"WHEN {leaf} IN {quoted(V.HOTEL_LEAVES)} THEN 'hotel' "
            f"WHEN {leaf} IN {quoted(V.SPORT_LEAVES)} THEN 'sport' "
            f"WHEN {leaf} IN {quoted(V.OPEN_SPACE_LEAVES)} THEN 'open_space' "
            f"ELSE CASE {top_case(leaf)} {tops} ELSE 'other' END END)")


def substring_case(col: str) -> str:
    arms = " ".join(f"WHEN {like_any(col, words)} THEN '{b}'" for b, words in V.SUBSTRING_RULES)
    return f"CASE WHEN {col} = '' THEN 'other' {arms} ELSE 'other' END"


OCC_CASE = ("CASE " + " ".join(
    f"WHEN starts_with(occtype, '{k}') THEN '{V.OCCUPANCY_PREFIX_BUCKET[k]}'"
    for k in sorted(V.OCCUPANCY_PREFIX_BUCKET, key=lambda k: -len(k))) + " ELSE 'other' END")
FAM = "regexp_extract(occtype, '^([A-Z]+)([0-9]+)', 1)"
NUMB = "TRY_CAST(regexp_extract(occtype, '^([A-Z]+)([0-9]+)', 2) AS INTEGER)"
GROUP_CASE = (f"CASE WHEN {NUMB} IS NULL THEN 'other' WHEN {FAM} = 'RES' THEN CASE WHEN {NUMB} = 4 "
              f"THEN 'hotel/institutional' ELSE 'residential' END WHEN {FAM} = 'COM' THEN CASE "
              f"WHEN {NUMB} = 1 THEN 'retail' WHEN {NUMB} = 4 THEN 'office' WHEN {NUMB} IN (8, 9) "
              f"THEN 'entertainment' WHEN {NUMB} IN (2, 3) THEN 'industrial/service' "
              f"ELSE 'civic/medical' END WHEN {FAM} IN ('IND', 'AGR') THEN 'industrial/service' "
              f"WHEN {FAM} IN ('REL', 'EDU', 'GOV') THEN 'civic/medical' ELSE 'other' END")


@query("c1_poi_bucket", f"""
    SELECT place_id, {program_case()} AS program FROM places""")
def _(L):
    return L.places().select("place_id", "program")


ALT1, ALT2 = pick(LEAVES, "(place_id * 31 + 6) % 24"), pick(LEAVES, "(place_id * 31 + 13) % 24")


@query("c2_leaf_bucket_with_alternates", f"""
    SELECT place_id, coalesce({top_case('leaf')}, '') AS top_level,
      CASE WHEN {leaf_case('leaf')} <> 'other' THEN {leaf_case('leaf')}
           WHEN {leaf_case('a1')} <> 'other' THEN {leaf_case('a1')}
           ELSE {leaf_case('a2')} END AS program
    FROM (SELECT place_id, leaf, {ALT1} AS a1, {ALT2} AS a2 FROM places) p""")
def _(L):
    p = L.view("places").withColumn("alt", F.array(F.expr(ALT1), F.expr(ALT2)))
    return p.select("place_id", F.coalesce(C.infer_top_level("leaf"), F.lit("")).alias("top_level"),
                    C.bucket_with_alternates("leaf", "alt").alias("program"))


@query("c3_substring_bucket", f"""
    SELECT place_id, {substring_case('leaf')} AS program FROM places""")
def _(L):
    return L.view("places").select("place_id", C.bucket_by_substring("leaf").alias("program"))


@query("c4_occupancy_bucket", f"SELECT structure_id, {OCC_CASE} AS bucket FROM structures")
def _(L):
    return L.view("structures").select("structure_id", C.occupancy_bucket("occtype").alias("bucket"))


@query("c5_occupancy_group", f"""
    SELECT structure_id, CASE WHEN structure_id % 23 = 0 THEN 'parking' ELSE {GROUP_CASE} END AS grp
    FROM structures""")
def _(L):
    return L.view("structures").select("structure_id", C.occupancy_group_with_parking(
        "occtype", F.when(F.col("structure_id") % 23 == 0, " Parking")).alias("grp"))


VENUE_NAME = ("CASE WHEN building_id % 20 = 7 THEN name || ' Ball Park (Old)' "
              "WHEN building_id % 9 = 0 THEN 'City Arena' ELSE name END")
TAG_CASE = "CASE lower(tag) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in
                                         V.BUILDING_TAG_PROGRAM.items()) + " END"


@query("c6_building_program", f"""
    SELECT building_id, CASE
      WHEN area_m2 > 4000 AND ({like_any('n', V.VENUE_NAME_TOKENS)}
        OR regexp_matches(n, ' ({'|'.join(V.VENUE_NAME_SUFFIXES)})$')) THEN 'sport'
      ELSE coalesce({TAG_CASE}, dom, 'other') END AS program
    FROM (SELECT *, trim(split_part(lower({VENUE_NAME}), '(', 1)) AS n,
          CASE WHEN building_id % 3 = 0 THEN 'hotel' END AS dom FROM buildings) b""")
def _(L):
    b = L.buildings()
    return b.select("building_id", C.building_program(
        F.expr(VENUE_NAME), "area_m2", "tag",
        F.when(F.col("building_id") % 3 == 0, "hotel")).alias("program"))


@query("c7_stadium_detector", f"""
    SELECT building_id, area_m2 >= 4000 AND coalesce({TAG_CASE}, 'other') NOT IN ('open_space', 'parking')
      AND (tag = 'stadium' OR coalesce({TAG_CASE}, 'other') = 'sport' OR coalesce(n, 0) >= 1
           OR (area_m2 > 22000 AND 4 * pi() * area_m2 / (perimeter_m * perimeter_m) > 0.55)
           OR area_m2 > 28000) AS is_stadium
    FROM buildings LEFT JOIN (SELECT building_id, count(*) AS n FROM place_bld
      WHERE inside AND program = 'sport' GROUP BY building_id) s USING (building_id)""")
def _(L):
    from townloom.operators.spatial import spatial_join

    b = L.buildings()
    sport = L.places().where("program = 'sport'")
    n = spatial_join(sport, b, ["building_id"]).groupBy("building_id").agg(F.count("*").alias("n"))
    program = C.building_program(F.lit(""), "area_m2", "tag", F.lit(None).cast("string"))
    comp = 4 * 3.141592653589793 * F.col("area_m2") / (F.col("perimeter_m") * F.col("perimeter_m"))
    none = F.lit(None).cast("string")
    return b.join(n, "building_id", "left").select("building_id", C.is_stadium(
        "area_m2", comp, program, "tag", none, none, none, "n").alias("is_stadium"))


ATTR = pick(["Residential - Multi", "warehouse", "single_family home", "Household goods",
             "non_residential", "Office", "public housing", ""], "parcel_id % 8")


@query("c8_residential_attribute", f"""
    SELECT parcel_id, v <> '' AND NOT {like_any('v', V.ATTR_EXCLUDED_SUBSTRINGS)}
      AND ({token_any('v', V.ATTR_RESIDENTIAL_TOKENS)}
           OR {like_any('v', V.ATTR_RESIDENTIAL_SUBSTRINGS)}) AS is_residential
    FROM (SELECT parcel_id, lower({ATTR}) AS v FROM parcels) p""")
def _(L):
    return L.view("parcels").select("parcel_id", C.attribute_is_residential(F.expr(ATTR)).alias(
        "is_residential"))


AUDIT_LEAF = pick(["apartment", "student_housing", "steakhouse", "residential_care", "dorm_hall",
                   "townhouse", "opera_house_housing", "bank", "condo-hotel"], "place_id % 9")


@query("c9_residential_audit_rule", f"""
    SELECT place_id, CASE WHEN {like_any('v', V.AUDIT_EXCLUDED_SUBSTRINGS)} THEN ''
      WHEN {token_any('v', V.AUDIT_TOKENS)} THEN 'token'
      WHEN {like_any('v', V.AUDIT_COMPOUNDS)} THEN 'compound'
      WHEN {like_any('v', V.AUDIT_SUBSTRINGS)} THEN 'substr' ELSE '' END AS rule
    FROM (SELECT place_id, {AUDIT_LEAF} AS v FROM places) p""")
def _(L):
    return L.view("places").select("place_id", C.residential_rule(F.expr(AUDIT_LEAF)).alias("rule"))


RAIL = pick(["station", "subway_entrance", "tram_stop", None, None], "stop_id % 5")
BUS = pick(["bus_stop", None, None, "bus_stop"], "stop_id % 4")


@query("c10_station_tier", f"""
    SELECT stop_id, CASE WHEN r = 'station' THEN 'rail_station' WHEN am = 'bus_station'
        THEN 'bus_station' WHEN r = 'subway_entrance' THEN 'subway_entrance'
        WHEN r = 'tram_stop' THEN 'tram_stop' WHEN h = 'bus_stop' THEN 'bus_stop'
        ELSE 'unknown' END AS kind,
      CASE WHEN r = 'station' OR am = 'bus_station' THEN 1
           WHEN r IN ('subway_entrance', 'tram_stop') THEN 2 ELSE 3 END AS tier
    FROM (SELECT DISTINCT stop_id, {RAIL} AS r, {BUS} AS h,
            CASE WHEN stop_id % 7 = 0 THEN 'bus_station' END AS am FROM stop_times) s""")
def _(L):
    s = L.view("stop_times").select("stop_id").distinct()
    kind = C.station_kind(F.expr(RAIL), F.lit(None).cast("string"),
                          F.when(F.col("stop_id") % 7 == 0, "bus_station"), F.expr(BUS))
    return s.select("stop_id", kind.alias("kind")).withColumn("tier", C.station_tier("kind"))


ROUTE_TYPE = pick(["0", "1", "2", "3", "700", "11", "4", "5", "12", "1200", "950", "x"], "route_id")


@query("c11_route_mode", """
    SELECT trip_id, mode FROM (SELECT DISTINCT trip_id, route_id FROM stop_times) t
    JOIN (VALUES (0, 'tram'), (1, 'subway'), (2, 'rail'), (3, 'bus'), (4, 'bus'), (5, 'bus'),
      (6, 'ferry'), (7, 'cable'), (8, 'monorail'), (9, 'monorail'), (10, 'tram'), (11, 'other'))
      m(route_id, mode) USING (route_id)""")
def _(L):
    return L.view("stop_times").select("trip_id", C.route_mode(F.expr(ROUTE_TYPE)).alias("mode")
                                       ).distinct()


@query("c12_tolerant_boolean", """
    SELECT place_id, lower(is_duplicate) IN ('true', 't', '1', 'yes', 'y') AS dup,
      lower(is_operational) IN ('true', 't', '1', 'yes', 'y') AS op FROM places""")
def _(L):
    return L.view("places").select("place_id", num.tolerant_bool_text("is_duplicate").alias("dup"),
                                   num.tolerant_bool_text("is_operational").alias("op"))


GTFS_TEXT = ("CASE WHEN seq % 50 = 0 THEN 'bad' ELSE CAST(dep_s {div} 3600 + 6 AS {str}) || ':' || "
             "lpad(CAST(dep_s {div} 60 % 60 AS {str}), 2, '0') || ':' || "
             "lpad(CAST(dep_s % 60 AS {str}), 2, '0') END")


@query("c13_gtfs_seconds", """
    SELECT seq, CASE WHEN seq % 50 = 0 THEN NULL ELSE dep_s + 21600 END AS seconds FROM stop_times""")
def _(L):
    text = F.expr(GTFS_TEXT.replace("{div}", "div").replace("{str}", "STRING"))
    return L.view("stop_times").select("seq", num.gtfs_seconds(text).alias("seconds"))


@query("c14_overlap_zone", """
    SELECT parcel_id, CASE WHEN r >= 0.7 THEN 'interior' WHEN r >= 0.1 THEN 'boundary'
      ELSE 'exterior' END AS zone
    FROM (SELECT parcel_id, (parcel_id % 101) / 100.0::double AS r FROM parcels) p""")
def _(L):
    return L.view("parcels").select("parcel_id", num.overlap_zone(
        (F.col("parcel_id") % 101) / F.lit(100.0)).alias("zone"))


@query("c15_safe_percentage", """
    SELECT unit_id, CASE WHEN occupied_total > 0 THEN 100 * renter_occupied / occupied_total END
        AS pct_renter,
      CASE WHEN median_household_income <> -666666666 THEN median_household_income END AS income,
      CASE WHEN edu_total_pop_25plus > 0 THEN 100 * (edu_bachelors + edu_masters
        + edu_professional + edu_doctorate) / edu_total_pop_25plus END AS pct_bachelors
    FROM units""", "pct_renter income pct_bachelors")
def _(L):
    edu = sum([F.col(f"edu_{x}") for x in ("masters", "professional", "doctorate")],
              F.col("edu_bachelors"))
    return L.view("units").select(
        "unit_id", num.safe_pct("renter_occupied", "occupied_total").alias("pct_renter"),
        num.null_if_sentinel("median_household_income").alias("income"),
        num.safe_pct(edu, "edu_total_pop_25plus").alias("pct_bachelors"))


@query("c16_levels_and_year", """
    SELECT structure_id, coalesce(CASE WHEN structure_id % 3 = 0 THEN CAST(num_story AS BIGINT) END,
        greatest(1, CAST(round(num_story * 3.5 / 3.5) AS BIGINT))) AS levels,
      CASE WHEN structure_id % 7 = 0 THEN NULL ELSE med_yr_blt END AS year_built,
      num_story * 3.5 AS height_m FROM structures""", "height_m")
def _(L):
    s = L.view("structures")
    tag = F.when(F.col("structure_id") % 3 == 0, F.col("num_story").cast("string")).otherwise("")
    year = F.when(F.col("structure_id") % 7 == 0, "1650-01-01").otherwise(
        F.concat(F.col("med_yr_blt").cast("string"), F.lit("-06")))
    return s.select("structure_id", num.levels(tag, height=F.col("num_story") * 3.5).alias("levels"),
                    num.year_in_window(year).alias("year_built"),
                    num.height_from_levels("num_story").alias("height_m"))


@query("c17_first_filled", """
    SELECT parcel_id, CASE WHEN usedesc <> '' THEN usedesc ELSE use_alt END AS use FROM parcels""")
def _(L):
    return L.view("parcels").select("parcel_id", num.first_filled("usedesc", "use_alt").alias("use"))


@query("c18_core_name", """
    SELECT district_id, regexp_replace(regexp_replace(regexp_replace(lower(code), '^[0-9]+[_-]', ''),
      '[_-][a-z]{2}$', ''), '[^a-z0-9]', '', 'g') AS core FROM districts""")
def _(L):
    return L.view("districts").select("district_id", num.core_name("code").alias("core"))


@query("c19_distances", """
    SELECT place_id, 2 * 6371000 * asin(sqrt(pow(sin(radians(y / 100 - 40) / 2), 2)
        + cos(radians(40)) * cos(radians(y / 100)) * pow(sin(radians(x / 100 - 5) / 2), 2))) AS haversine_m,
      x / 100 * 111320 * cos(radians(40.0)) AS width_m, y / 100 * 110540 AS height_m
    FROM places""", "haversine_m width_m height_m")
def _(L):
    span = geo.span_metres(F.col("x") / 100, F.col("y") / 100, F.lit(40.0))
    return L.view("places").select(
        "place_id", geo.haversine(F.lit(40.0), F.lit(5.0), F.col("y") / 100, F.col("x") / 100)
        .alias("haversine_m"), span["w"].alias("width_m"), span["h"].alias("height_m"))


@query("c20_bearing_sector", """
    SELECT place_id, b AS bearing, CAST(floor(((b + 22.5) - floor((b + 22.5) / 360) * 360) / 45) AS INTEGER)
        AS sector,
      (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(((b + 22.5)
        - floor((b + 22.5) / 360) * 360) / 45) AS INTEGER) + 1] AS compass
    FROM (SELECT place_id, a - floor(a / 360) * 360 AS b FROM (
      SELECT place_id, 90 - degrees(atan2(y - 500, x - 500)) AS a FROM places) q) p""", "bearing")
def _(L):
    return (L.view("places").select("place_id", geo.bearing(F.lit(500.0), F.lit(500.0), "x", "y")
                                    .alias("bearing"))
            .withColumn("sector", geo.sector("bearing"))
            .withColumn("compass", geo.compass(F.col("sector"))))


@query("c21_planner_tags", """
    SELECT district_id,
      CASE WHEN cov >= 0.25 THEN 'high-density urban' WHEN cov >= 0.15 THEN 'medium-density urban'
           WHEN cov >= 0.08 THEN 'moderate-density' ELSE 'low-density / suburban' END AS density,
      CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'mixed-program' END AS programs,
      CASE WHEN mx >= 0.2 THEN 'monolithic-anchor' WHEN n >= 5 THEN 'multi-anchor'
           WHEN n >= 2 THEN 'few-anchor' WHEN n >= 1 THEN 'single-anchor' ELSE 'anchor-light' END
        AS anchors
    FROM (SELECT district_id, sum(area_m2) / 1000000 AS cov, max(area_m2) / sum(area_m2) AS mx,
            count(*) FILTER (WHERE area_m2 > 4000) AS n FROM buildings GROUP BY 1) b
    JOIN (SELECT district_id, list_filter([
        CASE WHEN office >= 45 THEN 'office-dominated' WHEN office >= 30 THEN 'office-rich' END,
        CASE WHEN retail >= 35 THEN 'retail-led' WHEN retail >= 25 THEN 'retail-rich' END,
        CASE WHEN sport >= 7 THEN 'sport-anchored' WHEN sport >= 3 THEN 'with notable sport presence' END,
        CASE WHEN hotel >= 4 THEN 'hospitality-supported' END,
        CASE WHEN res >= 10 THEN 'residentially integrated' END], lambda t: t IS NOT NULL) AS tags
      FROM (SELECT district_id,
          100.0 * count(*) FILTER (WHERE program = 'office') / count(*) AS office,
          100.0 * count(*) FILTER (WHERE program = 'retail_food_entertainment') / count(*) AS retail,
          100.0 * count(*) FILTER (WHERE program = 'sport') / count(*) AS sport,
          100.0 * count(*) FILTER (WHERE program = 'hotel') / count(*) AS hotel,
          100.0 * count(*) FILTER (WHERE program = 'residential') / count(*) AS res
        FROM places_p GROUP BY 1) q) p USING (district_id)""")
def _(L):
    b = L.buildings().groupBy("district_id").agg(
        (F.sum("area_m2") / 1e6).alias("cov"), (F.max("area_m2") / F.sum("area_m2")).alias("mx"),
        F.count(F.when(F.col("area_m2") > 4000, 1)).alias("n"))
    pct = lambda v: (100.0 * F.count(F.when(F.col("program") == v, 1)) / F.count("*"))
    p = L.places().groupBy("district_id").agg(
        pct("office").alias("o"), pct("retail_food_entertainment").alias("r"),
        pct("sport").alias("s"), pct("hotel").alias("h"), pct("residential").alias("z"))
    return b.join(p, "district_id").select(
        "district_id", C.density_tag("cov").alias("density"),
        F.array_join(C.program_tags("o", "r", "s", "h", "z"), ", ").alias("programs"),
        C.anchor_structure("n", "mx").alias("anchors"))


@query("c24_family_name", """
    SELECT cluster_id, CASE WHEN count(*) OVER (PARTITION BY raw) > 1
      THEN raw || '_' || row_number() OVER (PARTITION BY raw ORDER BY cluster_id) ELSE raw END AS family
    FROM (SELECT cluster_id, concat_ws('-', CASE WHEN avg(area_m2) >= 800 THEN 'large'
          WHEN avg(area_m2) < 80 THEN 'small' ELSE 'mid' END,
        CASE WHEN avg(el) >= 2.3 THEN 'elongated' END,
        CASE WHEN avg(comp) >= 0.72 THEN 'compact' END) AS raw
      FROM (SELECT cluster_id, area_m2, greatest(a, b) / least(a, b) AS el,
              4 * pi() * area_m2 / (perimeter_m * perimeter_m) AS comp
            FROM buildings JOIN (SELECT building_id, a, b FROM buildings0) USING (building_id)) q
      GROUP BY 1) f""")
def _(L):
    from pyspark.sql import Window

    b = L.buildings().join(L.view("buildings0").select("building_id", "a", "b"), "building_id")
    comp = 4 * 3.141592653589793 * F.col("area_m2") / (F.col("perimeter_m") * F.col("perimeter_m"))
    prof = b.groupBy("cluster_id").agg(
        F.avg("area_m2").alias("area"), F.avg(F.greatest("a", "b") / F.least("a", "b")).alias("el"),
        F.avg(comp).alias("comp"))
    raw = prof.select("cluster_id", C.family_descriptor("area", "el", F.lit(4), "comp").alias("raw"))
    w = Window.partitionBy("raw")
    nth = F.row_number().over(w.orderBy("cluster_id"))
    return raw.select("cluster_id", F.when(F.count("*").over(w) > 1, F.concat_ws(
        "_", "raw", nth.cast("string"))).otherwise(F.col("raw")).alias("family"))


FEATURES = ["morph_coverage", "prog_pct_office", "prog_pct_sport", "anchor_count_inside",
            "demo_pop_density", "mth_lc_tree_pct", "eco_jobs_delta", "area_m2", "econ_income",
            "progocc_pct_office", "conn_span_hours", "morph_density_per_km2"]


@query("c26_feature_band", f"""
    SELECT parcel_id, f AS feature, CASE WHEN regexp_matches(f, '^(morph_|wave_|iex_|nolli_)')
        THEN 'morphology' WHEN regexp_matches(f, '^(program_|prog_|cat_)') THEN 'program'
        WHEN starts_with(f, 'anchor_') THEN 'anchor'
        WHEN regexp_matches(f, '^(demo_|census_|acs_)') THEN 'demographics'
        WHEN starts_with(f, 'mth_') THEN 'ecology' WHEN starts_with(f, 'eco_') THEN 'economic' END
        AS band,
      f NOT IN ('mth_lc_tree_pct', 'eco_jobs_delta') AS in_human
    FROM (SELECT parcel_id, {pick(FEATURES, 'parcel_id % 12')} AS f FROM parcels) p""")
def _(L):
    p = L.view("parcels").select("parcel_id", F.expr(pick(FEATURES, "parcel_id % 12")).alias("feature"))
    return p.withColumn("band", C.feature_band("feature")).withColumn(
        "in_human", C.in_band_set("feature", "human"))


@query("c27_metric_family", f"""
    SELECT parcel_id, starts_with(f, 'morph_') AS morphometric,
      f IN ('prog_pct_residential', 'prog_pct_office', 'prog_pct_sport',
        'prog_pct_retail_food_entertainment', 'prog_pct_hotel') AS livework,
      f IN ('morph_density_per_km2', 'morph_coverage', 'anchor_count_inside') AS intensity,
      starts_with(f, 'econ_') AS economic, starts_with(f, 'conn_') AS connectivity
    FROM (SELECT parcel_id, {pick(FEATURES, 'parcel_id % 12')} AS f FROM parcels) p""")
def _(L):
    p = L.view("parcels").select("parcel_id", F.expr(pick(FEATURES, "parcel_id % 12")).alias("f"))
    return p.select("parcel_id", *[C.in_family("f", k).alias(k) for k in (
        "morphometric", "livework", "intensity", "economic", "connectivity")])


@query("c28_building_and_parcel_filters", """
    SELECT 'structure' AS kind, structure_id AS id FROM structures
    WHERE starts_with(occtype, 'COM') AND num_story * 3.5 BETWEEN 7 AND 30
      AND med_yr_blt BETWEEN 1900 AND 1990
    UNION ALL SELECT 'parcel', parcel_id FROM parcels
    WHERE zoning <> '5-LOW' AND year_built BETWEEN 1920 AND 1980 AND owner = 'Owner 3'""")
def _(L):
    from townloom.operators.cards import filter_parcels, filter_structures

    s = filter_structures(L.view("structures"), families=["COM"], height=(7, 30), years=(1900, 1990))
    p = filter_parcels(L.view("parcels"), excluded=["5-LOW"], years=(1920, 1980), owner="Owner 3")
    return s.select(F.lit("structure").alias("kind"), F.col("structure_id").alias("id")).unionAll(
        p.select(F.lit("parcel"), "parcel_id"))


@query("c29_coordinate_sanity", """
    SELECT place_id FROM places WHERE x / 4 - 60 BETWEEN -180 AND 180
      AND y / 8 - 20 BETWEEN -90 AND 90""")
def _(L):
    from townloom.operators.cards import sane_coordinates

    p = L.view("places").withColumn("lon", F.col("x") / 4 - 60).withColumn("lat", F.col("y") / 8 - 20)
    return sane_coordinates(p).select("place_id")


@query("c30_projection", """
    SELECT place_id, CAST(floor((x / 3 - 170 + 180) / 6) + 1 AS INTEGER) AS zone,
      CAST(CASE WHEN y / 8 - 60 >= 0 THEN 32600 ELSE 32700 END + floor((x / 3 - 170 + 180) / 6) + 1
        AS INTEGER) AS epsg FROM places""")
def _(L):
    lon, lat = F.col("x") / 3 - 170, F.col("y") / 8 - 60
    return L.view("places").select("place_id", geo.utm_zone(lon).alias("zone"),
                                   geo.utm_epsg(lon, lat).alias("epsg"))


@query("c30_projected_metres")
def _(L):
    p = L.view("places").withColumn("lon", F.col("x") / 50 - 100).withColumn(
        "lat", F.col("y") / 50 + 28)
    return p.select("place_id", geo.utm_forward("lon", "lat").alias("u"),
                    geo.albers_forward("lon", "lat").alias("a")).select(
        "place_id", F.col("u.x").alias("utm_x"), F.col("u.y").alias("utm_y"),
        F.col("a.x").alias("albers_x"), F.col("a.y").alias("albers_y"))


@query("c31_log_transforms", """
    SELECT structure_id, ln(1 + coalesce(sqft, 0)) AS size_log,
      sign(num_story - 6) * log10(abs(num_story - 6) + 1e-12) AS signed_log,
      coalesce(sqft, 0) AS size_back FROM structures""", "size_log signed_log size_back")
def _(L):
    s = L.view("structures").withColumn("size_log", num.log_size("sqft"))
    return s.select("structure_id", "size_log",
                    num.signed_log(F.col("num_story") - 6).alias("signed_log"),
                    num.inverse_log_size("size_log").alias("size_back"))
