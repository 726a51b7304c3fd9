"""Queries for anchors, cards and node features."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.operators import anchors, cards, programs, spatial
from townloom.plans.aggregates import zoned_buildings
from townloom.plans.catalog import query
from townloom.plans.fixtures import crosses, seg_d2

BIG = "area_m2 > 4000"


@query("a17_polar_cells", "SELECT * FROM polar", extra={"polar": (POLAR := f"""
    SELECT district_id, building_id, sector, ring, arg_min(program, (-n, program)) AS dominant_program,
      sum(n)::BIGINT AS count FROM (SELECT d.district_id, d.building_id, d.program, CAST(CASE WHEN dist <= 30.48 THEN 0
        WHEN dist <= 76.2 THEN 1 ELSE 2 END AS INTEGER) AS ring, CAST(floor(((b + 22.5) - floor((b + 22.5) / 360) * 360) / 45)
        AS INTEGER) AS sector, count(*) AS n FROM (SELECT d.*, 90 - degrees(atan2(p.y - g.cy, p.x - g.cx)) AS b
        FROM place_bld d JOIN places p USING (place_id) JOIN buildings g ON g.building_id = d.building_id
        WHERE g.{BIG} AND dist <= 152.4) d GROUP BY ALL) q GROUP BY ALL""")})
def _(L):
    return anchors.polar_cells(L.buildings().where(BIG), L.places(), "building_id")


@query("c25_anchor_archetype", f"""
    SELECT district_id, building_id, CASE WHEN t IS NULL THEN 'morphological false positive'
      WHEN s <= 2 THEN 'asymmetric (' || p || ')' WHEN s >= 6 AND m / t >= 0.55 THEN 'distributed ' || p
      WHEN p = 'office' AND m / t > 0.5 THEN 'office tower' WHEN p = 'retail_food_entertainment' AND m / t > 0.5
      THEN 'retail-front anchor' WHEN p = 'sport' THEN 'asymmetric stadium' ELSE 'mixed-use (' || p || ' dom.)' END
      AS archetype FROM (SELECT district_id, building_id FROM buildings WHERE {BIG}) b
    LEFT JOIN (SELECT building_id, arg_min(dominant_program, (-n, dominant_program)) AS p, max(n) AS m, sum(n) AS t
      FROM (SELECT building_id, dominant_program, sum(count) AS n FROM polar GROUP BY ALL) q GROUP BY 1) c USING (building_id)
    LEFT JOIN (SELECT building_id, count(DISTINCT sector) AS s FROM polar GROUP BY 1) z USING (building_id)""",
       extra={"polar": POLAR})
def _(L):
    big = L.buildings().where(BIG)
    return anchors.archetype(big, anchors.polar_cells(big, L.places(), "building_id"), "building_id")


@query("a18_face_carpet", f"""
    SELECT f.building_id, CAST(f.i AS INTEGER) AS face, coalesce(n, 0) AS poi_count, len AS length_m FROM (
      SELECT building_id, i, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM bld_edges JOIN (SELECT building_id
        FROM buildings WHERE {BIG}) g USING (building_id)) f
    LEFT JOIN (SELECT building_id, i, count(*) AS n FROM (SELECT p.place_id, e.building_id, e.i,
        row_number() OVER (PARTITION BY p.place_id, e.building_id ORDER BY round({seg_d2('p.x', 'p.y')}, 6), e.i) AS r
      FROM places p JOIN bld_edges e USING (district_id) JOIN place_bld d ON d.place_id = p.place_id
        AND d.building_id = e.building_id AND d.dist <= 100) q WHERE r = 1 GROUP BY 1, 2) c
      ON c.building_id = f.building_id AND c.i = f.i""", "length_m")
def _(L):
    f = anchors.face_carpet(L.buildings().where(BIG), L.places(), "building_id")
    # a nearest point exactly on a corner belongs to both faces; count it on the first
    return corner_once(L, f).select("building_id", "face", "poi_count", "length_m")


def corner_once(L, faces):
    """Face counts with corner places kept on the earlier face only."""
    from townloom.functions import geo

    big = L.buildings().where(BIG)
    hits = spatial.spatial_join(L.places().select("district_id", "place_id", "x", "y"), big,
                                ["building_id", "rings"], within=100.0)
    hits = hits.select("building_id", "place_id", geo.arc_position(F.col("rings")[0], "x", "y").alias("a"))
    f = faces.select("building_id", "face", "arc_start", "arc_end")
    on = F.when(F.col("arc_end") < F.col("arc_start"), (F.col("a") >= F.col("arc_start"))
                | (F.col("a") <= F.col("arc_end"))).otherwise(F.col("a").between(
                    F.col("arc_start"), F.col("arc_end")))
    n = hits.join(f, "building_id").where(on).groupBy("building_id", "place_id").agg(
        F.min("face").alias("face")).groupBy("building_id", "face").agg(F.count("*").alias("_n"))
    return faces.join(n, ["building_id", "face"], "left").withColumn(
        "poi_count", F.coalesce("_n", F.lit(0)))


AX = ("SELECT district_id, 500.0::double AS ax, 500.0::double AS ay, radians((district_id % 36) * 5 + 2.5) AS t"
      " FROM districts")
RNG = """SELECT district_id, greatest(min(s) - 50, -707.0) AS s_min, least(max(s) + 50, 707.0) AS s_max FROM (
      SELECT district_id, s1 + (s2 - s1) * p1 / (p1 - p2) AS s FROM (SELECT e.district_id,
        (x1 - 500) * cos(t) + (y1 - 500) * sin(t) AS s1, (y1 - 500) * cos(t) - (x1 - 500) * sin(t) AS p1,
        (x2 - 500) * cos(t) + (y2 - 500) * sin(t) AS s2, (y2 - 500) * cos(t) - (x2 - 500) * sin(t) AS p2
        FROM bnd e JOIN ax0 USING (district_id)) q WHERE (p1 > 0) <> (p2 > 0)) z GROUP BY 1"""


@query("a20_axis_transect", """
    SELECT district_id, CAST(floor((s - s_min) / 50) AS INTEGER) AS bin, CASE WHEN p >= 0 THEN 'left' ELSE 'right' END AS side,
      program, count(*) AS n FROM (SELECT q.district_id, program, (x - 500) * cos(t) + (y - 500) * sin(t) AS s,
        (y - 500) * cos(t) - (x - 500) * sin(t) AS p FROM places_p q JOIN ax0 USING (district_id)) z
    JOIN rng USING (district_id) WHERE s BETWEEN s_min AND s_max AND abs(p) <= 150 GROUP BY ALL""",
       extra={"ax0": AX, "rng": RNG})
def _(L):
    axes = L.view("districts").select("district_id", F.lit(500.0).alias("ax"), F.lit(500.0).alias("ay"),
                                      ((F.col("district_id") % 36) * 5 + 2.5).alias("axis_deg"))
    r = anchors.transect_range(L.boundaries(), axes, 707.0)
    return anchors.transect(L.places(), r, 150.0)


def card_features(L):
    """Feature columns of the district cards, from one pass over places and footprints."""
    pct = lambda b: (100.0 * F.count(F.when(F.col("program") == b, 1)) / F.count("*"))
    p = L.places().groupBy("district_id").agg(*[pct(b).alias(f"prog_pct_{b}") for b in V.BUCKETS])
    h = programs.entropy(L.places(), ["district_id"], "program", name="prog_diversity")
    b = L.buildings().groupBy("district_id").agg(
        F.count("*").alias("buildings_inside"), (F.sum("area_m2") / 250000).alias("morph_coverage"),
        (F.count("*") * 40.0).alias("morph_density_per_km2"), F.percentile("area_m2", 0.5).alias(
            "morph_median_area_m2"),
        F.count(F.when(F.col("area_m2") > 4000, 1)).cast("double").alias("anchor_count_inside"),
        (F.max("area_m2") / F.sum("area_m2")).alias("anchor_max_area_ratio"))
    d = L.view("districts").select("district_id", F.col("city").alias("name"), "typology", "secondary")
    return d.join(p, "district_id").join(h, "district_id").join(b, "district_id").withColumn(
        "district_area_km2", F.lit(0.25))


CARD = "SELECT d.district_id, typology, p.*, b.*, h FROM districts d JOIN (SELECT district_id AS did, " + ", ".join(
    f"100.0 * count(*) FILTER (WHERE program = '{b}') / count(*) AS {b}" for b in V.BUCKETS) + """ FROM places_p GROUP BY 1) p
    ON p.did = d.district_id JOIN (SELECT district_id AS did2, sum(area_m2) / 250000 AS cov, count(*) AS nb, median(area_m2) AS med,
      count(*) FILTER (WHERE area_m2 > 4000) AS n, max(area_m2) / sum(area_m2) AS ratio FROM buildings GROUP BY 1) b
    ON did2 = d.district_id JOIN (SELECT district_id AS did3, sum(-q * ln(q)) AS h FROM (SELECT district_id, program,
      count(*) / sum(count(*)) OVER (PARTITION BY district_id) AS q FROM places_p GROUP BY 1, 2) e GROUP BY 1) h ON did3 = d.district_id"""
F0 = lambda c: f"printf('%.0f', {c})"
F1 = lambda c: f"printf('%.1f', {c})"
TOP = "greatest(retail_food_entertainment, office, sport, hotel, residential)"
TOPL = (f"CASE {TOP} WHEN retail_food_entertainment THEN 'retail/F&B' WHEN office THEN 'office' WHEN sport THEN 'sport'"
        " WHEN hotel THEN 'hospitality' ELSE 'residential' END")


@query("c22_strengths_opportunities", f"""
    SELECT district_id, array_to_string(list_filter([
        CASE WHEN n >= 5 THEN 'Multi-anchor district (' || n || ' anchors), reducing reliance on any single venue.'
          WHEN n >= 3 THEN 'Distributed anchor structure (' || n || ' anchors).' END,
        CASE WHEN hotel >= 3.5 AND sport >= 5 THEN 'Hotel + sport pairing (' || {F0('hotel')} || '% / ' || {F0('sport')}
          || '%) supports event-day visitor economy.' END,
        CASE WHEN h >= 1.5 AND {TOP} < 50 THEN 'Mixed-use programmatic profile (no single program above ' || {F0(TOP)} || '%).' END,
        CASE WHEN cov >= 0.22 THEN 'Dense built fabric (' || {F0('cov * 100')} || '% coverage).' END,
        CASE WHEN typology = 'Entertainment' AND retail_food_entertainment >= 30 AND sport >= 3 THEN 'Retail + sport base ('
          || {F0('retail_food_entertainment')} || '% / ' || {F0('sport')} || '%) aligned with entertainment typology.' END],
        lambda t: t IS NOT NULL)[1:3], ' | ') AS strengths,
      array_to_string(list_filter([
        CASE WHEN typology = 'Entertainment' AND office >= 40 THEN 'Program mix (' || {F0('office')}
          || '% office) reads more corporate than the ''entertainment'' typology suggests.'
          WHEN typology = 'Community' AND office >= 30 THEN 'Office concentration (' || {F0('office')}
          || '%) tilts the district toward daytime workforce rather than community fabric.' END,
        CASE WHEN residential < 1.5 AND hotel < 3 THEN 'Limited 24-hour activation (residential ' || {F1('residential')}
          || '%, hotel ' || {F1('hotel')} || '%).' WHEN residential < 1 THEN 'Minimal residential program (' || {F1('residential')}
          || '%) limits non-event vitality.' END,
        CASE WHEN ratio >= 0.25 THEN 'Single-anchor dependency: top anchor occupies ' || {F0('ratio * 100')}
          || '% of the district''s built area.' WHEN ratio >= 0.15 AND n <= 2 THEN 'Concentrated anchor footprint (top anchor = '
          || {F0('ratio * 100')} || '% of built area).' END,
        CASE WHEN {TOP} >= 55 THEN 'Mono-programmatic profile (' || {TOPL} || ' = ' || {F0(TOP)}
          || '% of POIs) limits programmatic resilience.' END,
        CASE WHEN parking >= 5 AND residential < 3 THEN 'Auto-supportive fabric (' || {F0('parking')}
          || '% parking POIs with limited residential).' END,
        CASE WHEN open_space < 1.5 AND cov > 0.1 THEN 'Open space deficit (' || {F1('open_space')}
          || '% of POIs) in a built-up fabric.' END], lambda t: t IS NOT NULL)[1:3], ' | ') AS opportunities
    FROM card""", extra={"card": CARD})
def _(L):
    s = cards.strengths(card_features(L))
    return s.select("district_id", F.array_join("strengths", " | ").alias("strengths"),
                    F.array_join("opportunities", " | ").alias("opportunities"))


TOP_LABELS = {"sport": "sport", "residential": "residential", "hotel": "hotel",
              "retail_food_entertainment": "retail / f&b", "office": "office", "parking": "parking",
              "open_space": "open space", "other": "other"}
MOST = f"greatest({', '.join(TOP_LABELS)})"
MOST_LABEL = "CASE " + " ".join(f"WHEN {b} = {MOST} THEN '{t}'" for b, t in TOP_LABELS.items()) + " END"


@query("c23_stat_callouts", f"""
    SELECT district_id, nb || ' buildings inside | 61.8 ac district area | ' || n || ' anchors detected | '
      || {F0('cov * 100')} || '% built coverage | ' || {F0(MOST)} || '% ' || {MOST_LABEL} || ' | '
      || CASE WHEN district_id % 2 = 0 THEN format('{{:,}}', CAST(round_even(people * 2.589988, 0) AS BIGINT))
        || ' people / sq mi' ELSE format('{{:,}}', CAST(round_even(med * 10.7639104167, 0) AS BIGINT))
        || ' sf median bldg area' END AS callouts
    FROM card JOIN (SELECT district_id, sum(total_pop) / 0.25::double AS people FROM units GROUP BY 1) u USING (district_id)""",
       extra={"card": CARD})
def _(L):
    # the density is known for every other district, so both forms of the last number occur
    people = L.units().groupBy("district_id").agg((F.sum("total_pop") / 0.25).alias("_d"))
    f = card_features(L).join(people, "district_id").withColumn(
        "demo_population_density", F.when(F.col("district_id") % 2 == 0, F.col("_d")))
    text = F.array_join(F.transform("callouts", lambda s: F.concat(s["value"], F.lit(" "), s["label"])), " | ")
    return cards.callouts(f).select("district_id", text.alias("callouts"))


@query("c32_character_description")
def _(L):
    f = card_features(L)
    cols = [f"prog_pct_{b}" for b in V.BUCKETS] + ["morph_coverage"]
    return cards.character(f, programs.peer_medians(f, "typology", cols))
