"""Queries for program, structure, census, jobs and parcel aggregates (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import classify as C
from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.operators import cards, census, programs, spatial
from townloom.plans.catalog import query
from townloom.plans.classification import GROUP_CASE, OCC_CASE
from townloom.plans.joins import UNIT_CELLS

BUCKET_ROWS = "(VALUES " + ", ".join(f"('{b}')" for b in V.BUCKETS) + ") bk(program)"


def zoned_places(L):
    return spatial.assign_zone(L.places(), L.boundaries())


def zoned_buildings(L):
    return spatial.assign_zone(L.buildings(), L.boundaries(), "cx", "cy")


@query("a1_zone_shares", """
    SELECT district_id, zone, program, n, round(100.0 * n / sum(n) OVER (
      PARTITION BY district_id, zone), 2) AS pct FROM (
      SELECT district_id, zone, program, count(*) AS n FROM place_zone GROUP BY ALL
      UNION ALL SELECT district_id, 'all', program, count(*) FROM place_zone GROUP BY ALL) q""", "pct")
def _(L):
    return programs.zone_shares(zoned_places(L))


CONTRAST = f"""SELECT district_id, program,
      coalesce(round(100.0 * count(*) FILTER (WHERE zone = 'interior' AND p.program = bk.program)
        / nullif(count(*) FILTER (WHERE zone = 'interior'), 0), 2), 0) AS interior_pct,
      coalesce(round(100.0 * count(*) FILTER (WHERE zone = 'exterior' AND p.program = bk.program)
        / nullif(count(*) FILTER (WHERE zone = 'exterior'), 0), 2), 0) AS exterior_pct
    FROM (SELECT district_id, zone, program FROM place_zone) p, {BUCKET_ROWS}"""
CONTRAST = CONTRAST.replace("SELECT district_id, program,", "SELECT district_id, bk.program AS program,"
                            ) + " GROUP BY 1, 2"


@query("a2_interior_exterior", """SELECT *, interior_pct - exterior_pct AS difference
    FROM contrast""", "interior_pct exterior_pct difference", extra={"contrast": CONTRAST})
def _(L):
    return programs.interior_exterior(zoned_places(L))


A3_SQL = """
    SELECT b.building_id, b.cluster_id, b.district_id, b.area_m2, coalesce(n_in, 0) AS place_count_inside,
      coalesce(n_adj, 0) AS place_count_adjacent, dom AS dominant_program_inside,
      coalesce(list_in, '') AS inside FROM buildings b
    LEFT JOIN (SELECT building_id, sum(n)::BIGINT AS n_in, min_by(program, (-n, program)) AS dom,
      string_agg(program || ':' || n, ';' ORDER BY program) AS list_in FROM (
        SELECT building_id, program, count(*) AS n FROM place_bld WHERE inside GROUP BY ALL) q
      GROUP BY 1) i USING (building_id)
    LEFT JOIN (SELECT building_id, count(*) AS n_adj FROM place_bld WHERE dist <= 10 GROUP BY 1) a
      USING (building_id)"""


@query("a3_building_programs", """SELECT building_id, place_count_inside, place_count_adjacent,
    dominant_program_inside, inside FROM enriched""", extra={"enriched": A3_SQL})
def _(L):
    e = programs.building_programs(L.buildings(), L.places())
    text = F.array_join(F.transform(F.array_sort(F.map_entries("programs_inside")), lambda s: F.concat(
        s["key"], F.lit(":"), s["value"].cast("string"))), ";")
    return e.select("building_id", "place_count_inside", "place_count_adjacent",
                    "dominant_program_inside", text.alias("inside"))


@query("a4_cluster_crosstab", f"""
    SELECT district_id, cluster_id, count(DISTINCT building_id) AS n_buildings,
      count(DISTINCT building_id) FILTER (WHERE place_count_inside > 0) AS buildings_with_programs,
      count(program) AS n_programs_inside, {', '.join(
        f"round(coalesce(count(*) FILTER (WHERE program = '{b}') / nullif(count(program), 0), 0), 4) AS pct_{b}"
        for b in V.BUCKETS)}
    FROM enriched LEFT JOIN (SELECT building_id, program FROM place_bld WHERE inside) p USING (building_id)
    GROUP BY ALL""", " ".join(f"pct_{b}" for b in V.BUCKETS), extra={"enriched": A3_SQL})
def _(L):
    e = programs.building_programs(L.buildings(), L.places())
    return programs.cluster_crosstab(e).drop("dominant_program", "median_area_m2")


def weighted_units(L):
    o = spatial.overlap_by_cells(L.units(), L.boundaries(), "unit_id", 10.0)
    return L.view("units").join(o.select("unit_id", "overlap_ratio"), "unit_id")


def demo_sql(weight: str) -> str:
    s = lambda c: f"sum({c} * {weight})"
    m = lambda c: (f"sum(CASE WHEN {c} <> -666666666 AND total_pop * {weight} > 0 THEN {c} * total_pop * {weight} END) "
                   f"/ sum(CASE WHEN {c} <> -666666666 AND total_pop * {weight} > 0 THEN total_pop * {weight} END)")
    p = lambda a, b: f"CASE WHEN {s(b)} > 0 THEN round(100 * ({a}) / {s(b)}, 1) END"
    return f"""SELECT district_id, count(*) AS units_total, round({s('total_pop')}) AS estimated_population,
      {m('median_age')} AS median_age_pop_weighted,
      {m('median_household_income')} AS median_household_income_pop_weighted,
      round({s('occupied_total')}) AS occupied_housing_units,
      {p(s('owner_occupied'), 'occupied_total')} AS pct_owner_occupied,
      {p(s('renter_occupied'), 'occupied_total')} AS pct_renter_occupied,
      {m('median_home_value')} AS median_home_value_pop_weighted,
      {m('median_gross_rent')} AS median_gross_rent_pop_weighted,
      {p(' + '.join(s('edu_' + e) for e in ('bachelors', 'masters', 'professional', 'doctorate')), 'edu_total_pop_25plus')}
        AS pct_bachelors_or_higher,
      {p(s('race_white'), 'race_total')} AS pct_white, {p(s('race_black'), 'race_total')} AS pct_black,
      {p(s('race_asian'), 'race_total')} AS pct_asian, {p(s('hispanic'), 'race_total')} AS pct_hispanic,
      {p(s('unemployed'), 'labor_force')} AS unemployment_rate
    FROM wunits GROUP BY 1"""


WUNITS = "SELECT u.*, c.overlap_ratio FROM units u JOIN unit_cells c USING (unit_id)"
DEMO_COLS = ("estimated_population median_age_pop_weighted median_household_income_pop_weighted "
             "occupied_housing_units pct_owner_occupied pct_renter_occupied "
             "median_home_value_pop_weighted median_gross_rent_pop_weighted "
             "pct_bachelors_or_higher pct_white pct_black pct_asian pct_hispanic unemployment_rate")
UNIT_EXTRA = {"unit_cells": UNIT_CELLS, "wunits": WUNITS}


@query("a5_demographics_weighted", demo_sql("overlap_ratio"), DEMO_COLS, extra=UNIT_EXTRA)
def _(L):
    return census.demographics(weighted_units(L), "overlap_ratio")


@query("a5_demographics_unit_weight", demo_sql("1"), DEMO_COLS,
       extra={"wunits": "SELECT * FROM units"})
def _(L):
    return census.demographics(L.view("units").withColumn("one", F.lit(1.0)), "one")


SECT = {k: "(" + " + ".join(f"sum(CASE WHEN sector = {int(c[3:]) - 1} THEN jobs * w ELSE 0 END)"
                            for c in cs) + ")" for k, cs in V.SECTOR_ROLLUP.items()}
CONS = " + ".join(SECT[k] for k in V.CONSUMER_SECTORS)
WJOBS = ("SELECT j.*, CASE WHEN block_no % 4 = 0 THEN 0.5::double ELSE 1.0::double END AS w "
         "FROM jobs_long j")


@query("a6_jobs_summary", f"""
    SELECT district_id, yr, round(t) AS jobs_inside, {', '.join(f'round(s_{k}, 4) AS jobs_{k}' for k in SECT)},
      round(cons) AS consumer_serving_jobs, round(100 * s_office_knowledge / t, 1) AS office_knowledge_pct,
      round(100 * cons / t, 1) AS consumer_serving_pct, round(100 * hi / t, 1) AS pct_jobs_high_earning,
      round(100 * lo / t, 1) AS pct_jobs_low_earning, NULL::double AS pct_jobs_young_firms,
      (SELECT min_by(k, (-round(v, 6), k)) FROM (VALUES {', '.join(f"('{k}', s_{k})" for k in SECT)}) z(k, v))
        AS top_sector
    FROM (SELECT district_id, yr, sum(jobs * w) AS t, {', '.join(f'{v} AS s_{k}' for k, v in SECT.items())},
      {CONS} AS cons, sum(CASE WHEN band = 2 THEN jobs * w ELSE 0 END) AS hi,
      sum(CASE WHEN band = 0 THEN jobs * w ELSE 0 END) AS lo FROM wjobs GROUP BY 1, 2) q""",
       "jobs_inside consumer_serving_jobs office_knowledge_pct consumer_serving_pct "
       "pct_jobs_high_earning pct_jobs_low_earning pct_jobs_young_firms "
       + " ".join(f"jobs_{k}" for k in SECT), extra={"wjobs": WJOBS})
def _(L):
    b = census.jobs_wide(L.view("jobs_long"), ["district_id", "block_no", "yr"]).withColumn(
        "w", F.when(F.col("block_no") % 4 == 0, 0.5).otherwise(1.0))
    return census.jobs_summary(b, "w", ["district_id", "yr"])


STRUCT = f"SELECT *, {OCC_CASE} AS bucket FROM structures"
SBUCK = "(VALUES " + ", ".join(f"('{b}')" for b in V.STRUCTURE_BUCKETS) + ") bk(bucket)"
SSHARE = f"""SELECT t.district_id, bk.bucket, coalesce(b.n, 0) AS n,
      round(coalesce(coalesce(b.s, 0) / nullif(t.s, 0), 0), 4) AS share_sqft,
      round(coalesce(b.n, 0) / t.n, 4) AS share_count, t.n AS n_structures, t.s AS total_sqft,
      t.miss AS missing_sqft, round(coalesce(b.s, 0) / t.s, 4) AS share
    FROM (SELECT district_id, count(*) AS n, sum(coalesce(sqft, 0)) AS s, count(*) - count(sqft) AS miss
      FROM st GROUP BY 1) t CROSS JOIN {SBUCK}
    LEFT JOIN (SELECT district_id, bucket, count(*) AS n, sum(coalesce(sqft, 0)) AS s FROM st GROUP BY ALL) b
      ON b.district_id = t.district_id AND b.bucket = bk.bucket"""
ST_EXTRA = {"st": STRUCT, "sshare": SSHARE}


def bucketed(L):
    return L.view("structures").withColumn("bucket", C.occupancy_bucket("occtype"))


@query("a7_structure_shares", "SELECT * FROM sshare", "share_sqft share_count total_sqft share",
       extra=ST_EXTRA)
def _(L):
    return programs.structure_shares(bucketed(L))


@query("a7_structure_gate", """
    SELECT district_id, max(n_structures) AS n_structures, sum(share_sqft) FILTER (WHERE bucket = 'other')
      AS other_share, sum(share_sqft) > 0 AND max(n_structures) >= 5
      AND sum(share_sqft) FILTER (WHERE bucket = 'other') < 0.5 AS usable FROM sshare GROUP BY 1""",
       "other_share", extra=ST_EXTRA)
def _(L):
    return programs.structure_gate(programs.structure_shares(bucketed(L)))


@query("a7_code_histogram", """
    SELECT district_id, substr(occtype, 1, 8) AS code, count(*) AS n FROM structures GROUP BY ALL""")
def _(L):
    return programs.code_histogram(L.view("structures"))


OCC_OF = ("SELECT b.*, " + GROUP_CASE.replace("occtype", "code") + " AS grp FROM (SELECT *, "
          "(['RES1','RES4','COM1','COM4','COM8','IND1','GOV1'])[building_id % 7 + 1] AS code FROM buildings) b")


@query("a8_occupancy_mix", f"""
    SELECT district_id, {', '.join(
        f"100 * sum(CASE WHEN grp = '{g}' THEN area_m2 ELSE 0 END) / sum(area_m2) AS progocc_pct_{g.replace('/', '_')}"
        for g in V.OCCUPANCY_GROUPS)}, any_value(h) AS progocc_diversity
    FROM ob JOIN (SELECT district_id, sum(-p * ln(p)) AS h FROM (SELECT district_id, grp,
        sum(area_m2) / sum(sum(area_m2)) OVER (PARTITION BY district_id) AS p FROM ob GROUP BY 1, 2) q
      GROUP BY 1) e USING (district_id) GROUP BY 1""",
       " ".join("progocc_pct_" + g.replace("/", "_") for g in V.OCCUPANCY_GROUPS) + " progocc_diversity",
       extra={"ob": OCC_OF})
def _(L):
    code = F.element_at(F.array(*[F.lit(v) for v in ("RES1", "RES4", "COM1", "COM4", "COM8", "IND1",
                                                     "GOV1")]),
                        (F.col("building_id") % 7 + 1).cast("int"))
    return programs.occupancy_mix(L.buildings().withColumn("occupancy_group", C.occupancy_group(code)))


DAREA = ("SELECT district_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS darea FROM bnd GROUP BY 1")


def district_area(L):
    return L.boundaries().select("district_id", geo.area("rings").alias("area_m2"))


MORPH = """SELECT d.district_id, coalesce(n, 0) / (darea / 1e6) AS morph_density_per_km2,
      coalesce(s, 0) / darea AS morph_coverage, coalesce(q50, 0) AS morph_median_area_m2,
      coalesce(q75 - q25, 0) AS morph_area_iqr,
      coalesce(CASE WHEN n > 2 AND sd > 1e-12 THEN m3 / pow(sd, 3) END, 0) AS morph_area_log_skew,
      coalesce(comp, 0) AS morph_mean_compactness, coalesce(r, 0) AS morph_orientation_R,
      coalesce(h, 0) AS morph_cluster_diversity
    FROM darea_t d LEFT JOIN (SELECT district_id, count(*) AS n, sum(area_m2) AS s,
        quantile_cont(area_m2, 0.25) AS q25, quantile_cont(area_m2, 0.5) AS q50,
        quantile_cont(area_m2, 0.75) AS q75, stddev_pop(la) AS sd, avg(pow(la - mu, 3)) AS m3,
        avg(4 * pi() * area_m2 / (perimeter_m * perimeter_m)) AS comp,
        sqrt(pow(avg(cos(radians(orientation_deg * 2))), 2)
          + pow(avg(sin(radians(orientation_deg * 2))), 2)) AS r
      FROM (SELECT *, ln(1 + area_m2) AS la, avg(ln(1 + area_m2)) OVER (PARTITION BY district_id) AS mu
        FROM bld_zone WHERE zone = 'interior') z GROUP BY 1) m USING (district_id)
    LEFT JOIN (SELECT district_id, sum(-p * ln(p + 1e-12)) AS h FROM (SELECT district_id, cluster_id,
        count(*) / sum(count(*)) OVER (PARTITION BY district_id) AS p FROM bld_zone
        WHERE zone = 'interior' GROUP BY 1, 2) c GROUP BY 1) e USING (district_id)"""
MORPH_COLS = ("morph_density_per_km2 morph_coverage morph_median_area_m2 morph_area_iqr "
              "morph_area_log_skew morph_mean_compactness morph_orientation_R morph_cluster_diversity")


@query("a9_a11_morphology", "SELECT * FROM morph", MORPH_COLS, extra={"darea_t": DAREA, "morph": MORPH})
def _(L):
    return programs.morphology(zoned_buildings(L).where("zone = 'interior'"), district_area(L))


@query("a10_entropy", """
    SELECT district_id, sum(-p * ln(p)) AS plain, sum(-p * ln(p + 1e-12)) AS padded FROM (
      SELECT district_id, program, count(*) / sum(count(*)) OVER (PARTITION BY district_id) AS p
      FROM places_p GROUP BY 1, 2) q GROUP BY 1""", "plain padded")
def _(L):
    p = L.places()
    return programs.entropy(p, ["district_id"], "program", name="plain").join(
        programs.entropy(p, ["district_id"], "program", eps=1e-12, name="padded"), "district_id")


@query("a12_owner_gini", """
    SELECT district_id, 2 * sum(i * owned) / (count(*) * sum(owned)) - (count(*) + 1) / count(*) AS gini
    FROM (SELECT district_id, owned, row_number() OVER (PARTITION BY district_id ORDER BY owned) AS i
      FROM (SELECT district_id, owner, sum(acres) AS owned FROM parcels GROUP BY ALL) o) q GROUP BY 1""",
       "gini")
def _(L):
    owned = L.view("parcels").groupBy("district_id", "owner").agg(F.sum("acres").alias("owned"))
    return census.gini(owned, ["district_id"], "owned")


PARCEL = """SELECT district_id, parcel_count, round(acres, 2) AS total_acres, vacant AS vacant_share,
      exempt AS tax_exempt_share, dens AS mean_bldg_density_per_acre, round(land) AS mean_land_value,
      round(bldg) AS mean_bldg_value, g AS ownership_gini, top5 / acres AS top5_owner_share,
      med::double AS year_built_median, h AS zoning_diversity
    FROM (SELECT district_id, count(*) AS parcel_count, sum(acres) AS acres,
        avg(CASE WHEN bldg_sqft > 0 THEN 0 ELSE 1 END) AS vacant,
        avg(CASE WHEN exemption <> '' THEN 1 ELSE 0 END) AS exempt, avg(bldg_sqft / acres) AS dens,
        avg(nullif(land_value, 0)) AS land, avg(nullif(bldg_value, 0)) AS bldg,
        (list_sort(list(year_built) FILTER (WHERE year_built IS NOT NULL)))[count(year_built) // 2 + 1] AS med
      FROM parcels GROUP BY 1) b
    JOIN (SELECT district_id, 2 * sum(i * owned) / (count(*) * sum(owned)) - (count(*) + 1) / count(*) AS g,
        sum(owned) FILTER (WHERE j <= 5) AS top5
      FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY owned) AS i,
          row_number() OVER (PARTITION BY district_id ORDER BY owned DESC, owner) AS j
        FROM (SELECT district_id, owner, sum(acres) AS owned FROM parcels GROUP BY ALL) o) q GROUP BY 1) o
      USING (district_id)
    JOIN (SELECT district_id, sum(-p * ln(p)) AS h FROM (SELECT district_id, zoning, count(*)
        / sum(count(*)) OVER (PARTITION BY district_id) AS p FROM parcels GROUP BY 1, 2) z GROUP BY 1) z
      USING (district_id)"""
PARCEL_COLS = ("total_acres vacant_share tax_exempt_share mean_bldg_density_per_acre mean_land_value "
               "mean_bldg_value ownership_gini top5_owner_share year_built_median zoning_diversity")


@query("a13_parcel_summary", "SELECT * FROM parcel_t", PARCEL_COLS, extra={"parcel_t": PARCEL})
def _(L):
    return census.parcel_summary(L.view("parcels"))


@query("a13_top_uses_and_decades", """
    SELECT 'use' AS kind, district_id, value, n, rank FROM (SELECT district_id, use AS value, count(*) AS n,
      CAST(row_number() OVER (PARTITION BY district_id ORDER BY count(*) DESC, use) AS INTEGER) AS rank
      FROM (SELECT district_id, CASE WHEN usedesc <> '' THEN usedesc ELSE use_alt END AS use FROM parcels) p
      WHERE use IS NOT NULL GROUP BY 1, 2) q WHERE rank <= 10
    UNION ALL SELECT 'decade', district_id, CAST(year_built // 10 * 10 AS VARCHAR), count(*), 0
    FROM parcels WHERE year_built IS NOT NULL GROUP BY ALL""")
def _(L):
    from townloom.functions.num import first_filled

    p = L.view("parcels")
    use = census.top_values(p, first_filled("usedesc", "use_alt"))
    dec = census.decade_histogram(p)
    return use.select(F.lit("use").alias("kind"), "district_id", "value", "n", "rank").unionByName(
        dec.select(F.lit("decade").alias("kind"), "district_id",
                   F.col("decade").cast("string").alias("value"), "n", F.lit(0).alias("rank")))


ANCH = """SELECT d.district_id, coalesce(n, 0)::double AS anchor_count_inside,
      coalesce(top1 / t, 0) AS anchor_max_area_ratio,
      coalesce(top1 / top3, 0) AS anchor_size_concentration
    FROM districts d LEFT JOIN (SELECT district_id, sum(area_m2) AS t FROM bld_zone
      WHERE zone = 'interior' GROUP BY 1) b USING (district_id)
    LEFT JOIN (SELECT district_id, count(*) AS n, max(area_m2) AS top1,
      sum(area_m2) FILTER (WHERE r <= 3) AS top3 FROM (SELECT *, row_number() OVER (
        PARTITION BY district_id ORDER BY area_m2 DESC, building_id) AS r FROM bld_zone
        WHERE zone = 'interior' AND area_m2 > 4000) a GROUP BY 1) a USING (district_id)"""
ANCH_COLS = "anchor_count_inside anchor_max_area_ratio anchor_size_concentration"


@query("a15_anchor_features", "SELECT * FROM anch", ANCH_COLS, extra={"anch": ANCH})
def _(L):
    z = zoned_buildings(L).where("zone = 'interior'").select("district_id", "building_id", "area_m2")
    return programs.anchor_features(z.where("area_m2 > 4000"), z, L.view("districts"))


ACL = """SELECT district_id, min_by(cluster_id, (-m, cluster_id)) AS anchor_cluster,
    max(m) AS median_area_m2 FROM (SELECT district_id, cluster_id, median(area_m2) AS m FROM buildings
    GROUP BY ALL) q GROUP BY 1"""


@query("a16_anchor_cluster", "SELECT * FROM acl", "median_area_m2", extra={"acl": ACL})
def _(L):
    return programs.anchor_cluster(L.buildings())


@query("a19_modal_orientation", """
    SELECT district_id, (min_by(bin, (-round(w, 6), bin)) + 0.5) * 5 AS axis_deg FROM (
      SELECT district_id, least(floor(orientation_deg / 5), 35) AS bin, sum(area_m2 * CASE WHEN
        cluster_id = anchor_cluster THEN 10 ELSE 1 END) AS w FROM buildings JOIN acl USING (district_id)
      GROUP BY 1, 2) q GROUP BY 1""", "axis_deg", extra={"acl": ACL})
def _(L):
    return programs.modal_orientation(L.buildings())


@query("a37_building_quantiles", """
    SELECT district_id, count(*) AS n_buildings, quantile_cont(area_m2, 0.25) AS p25,
      quantile_cont(area_m2, 0.5) AS median, quantile_cont(area_m2, 0.75) AS p75
    FROM buildings GROUP BY 1""", "p25 median p75")
def _(L):
    return programs.building_quantiles(L.buildings())


@query("a38_category_summary", "SELECT district_id, leaf, count(*) AS n FROM places GROUP BY ALL")
def _(L):
    return programs.category_summary(L.view("places"))


@query("a38_residential_audit", """
    SELECT district_id, program, leaf, CASE leaf WHEN 'apartment' THEN 'token' ELSE 'compound' END AS rule,
      count(*) AS n, count(*) FILTER (WHERE zone = 'interior') AS n_interior FROM place_zone
    WHERE leaf IN ('apartment', 'housing_authority') GROUP BY ALL""")
def _(L):
    return programs.residential_audit(zoned_places(L))


@query("a39_peer_medians", f"""
    SELECT typology, feature, count(*) AS n_peers, median(value) AS median FROM (
      UNPIVOT (SELECT typology, {', '.join(MORPH_COLS.split())} FROM morph JOIN districts USING (district_id))
      ON {', '.join(MORPH_COLS.split())} INTO NAME feature VALUE value) u
    GROUP BY 1, 2 HAVING count(*) >= 3""", "median", extra={"darea_t": DAREA, "morph": MORPH})
def _(L):
    m = programs.morphology(zoned_buildings(L).where("zone = 'interior'"), district_area(L))
    f = m.join(L.view("districts").select("district_id", "typology"), "district_id")
    return programs.peer_medians(f, "typology", MORPH_COLS.split())


@query("a40_coverage_matrix", """
    SELECT district_id, EXISTS (SELECT 1 FROM buildings b WHERE b.district_id = d.district_id AND area_m2
        > 15000) AS has_large, EXISTS (SELECT 1 FROM places p WHERE p.district_id = d.district_id
        AND leaf = 'casino') AS has_casino FROM districts d""")
def _(L):
    return programs.coverage_matrix(L.view("districts"), {
        "large": L.buildings().where("area_m2 > 15000"),
        "casino": L.view("places").where("leaf = 'casino'")})
