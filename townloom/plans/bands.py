"""Queries over whole feature rows: districts (M1, M9, M26, A41, A43) and footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import classify as C
from townloom.functions import vocab as V
from townloom.functions.num import null_if_sentinel
from townloom.operators import census, features, programs, spatial
from townloom.operators import similarity as sim
from townloom.plans.aggregates import (ANCH, CONTRAST, DAREA, DEMO_COLS, MORPH, OCC_OF, UNIT_EXTRA, demo_sql, district_area,
                                       weighted_units, zoned_buildings, zoned_places)
from townloom.plans.catalog import query
from townloom.plans.graphs import CENTRAL, WALK_CELLS, street_centrality, walkshed
from townloom.plans.panels import LEVEL, LEVEL_COLS
from townloom.plans.transit import SERVICE, caught_stops, route_modes, served_departures
from townloom.operators.transit import level_of_service

B = V.BUCKETS
QUOTED = lambda vs: "(" + ", ".join(f"'{v}'" for v in vs) + ")"


def area_km2(L):
    return district_area(L).select("district_id", (F.col("area_m2") / 1e6).alias("area_km2"))


# --- A41 ----------------------------------------------------------------------------------------

CONN_COLS = ("conn_stations_per_km2 conn_routes_serving conn_trips_per_day conn_headway_inv conn_span_hours conn_stops_in_buffer "
             "conn_stops_inside_ratio conn_walkshed_area conn_street_mean_centrality conn_street_density")
CONN = f"""
    SELECT d.district_id, coalesce(t.n / (a.darea / 1e6), 0)::double AS conn_stations_per_km2,
      coalesce(l.routes_serving, 0)::double AS conn_routes_serving, coalesce(l.trips_per_day, 0)::double AS conn_trips_per_day,
      coalesce(CASE WHEN l.median_route_headway_min > 0 THEN 60 / l.median_route_headway_min END, 0)::double AS conn_headway_inv,
      coalesce(l.span_hours, 0)::double AS conn_span_hours, coalesce(c.n, 0)::double AS conn_stops_in_buffer,
      coalesce(c.i / c.n, 0)::double AS conn_stops_inside_ratio, coalesce(w.m, 0)::double AS conn_walkshed_area,
      coalesce(z.mean_centrality_nonzero, 0)::double AS conn_street_mean_centrality,
      coalesce(z.feature_count / (a.darea / 1e6), 0)::double AS conn_street_density
    FROM districts d JOIN darea_t a USING (district_id) LEFT JOIN los l USING (district_id)
    LEFT JOIN (SELECT district_id, count(*) AS n FROM places WHERE leaf IN {QUOTED(V.TRANSIT_LEAVES)} GROUP BY 1) t USING (district_id)
    LEFT JOIN (SELECT district_id, count(*) AS n, count(*) FILTER (WHERE inside) AS i FROM caught GROUP BY 1) c USING (district_id)
    LEFT JOIN (SELECT district_id, count(*) * 400.0 AS m FROM shed GROUP BY 1) w USING (district_id)
    LEFT JOIN central z USING (district_id)"""
CONN_EX = {"darea_t": DAREA, **SERVICE, **WALK_CELLS, **CENTRAL, "conn": CONN}


def connectivity(L):
    """A41 fed by its operators: level of service of the catchment, walkshed and street centrality."""
    per = lambda df, *aggs: df.groupBy("district_id").agg(*aggs)
    stops = per(caught_stops(L), F.count("*").alias("stops_in_buffer"),
                F.count(F.when(F.col("catchment") == "inside", 1)).alias("stops_inside"))
    stations = per(L.view("places").where(F.col("leaf").isin(V.TRANSIT_LEAVES)), F.count("*").alias("total_stations"))
    return features.connectivity(area_km2(L), stations.join(stops, "district_id", "full"),
                                 level_of_service(served_departures(L), route_modes(L)),
                                 walkshed(L).withColumnRenamed("area_m2", "walk_area"), street_centrality(L))


@query("a41_connectivity", "SELECT * FROM conn", CONN_COLS, extra=CONN_EX)
def _(L):
    return L.view("districts").select("district_id").join(connectivity(L), "district_id")


# --- M1, M26 ------------------------------------------------------------------------------------

MORPH_COLS = ("morph_density_per_km2 morph_coverage morph_median_area_m2 morph_area_iqr morph_area_log_skew "
              "morph_mean_compactness morph_orientation_R morph_cluster_diversity")
PROG_COLS = " ".join(f"prog_pct_{b}" for b in B) + " prog_diversity"
ANCH_COLS = "anchor_count_inside anchor_max_area_ratio anchor_size_concentration"
PEOPLE_COLS = ("demo_population_density demo_median_age demo_median_hh_income demo_median_home_value demo_pct_bachelors_plus "
               "demo_unemployment_rate demo_racial_diversity")
OCC_COLS = " ".join("progocc_pct_" + g.replace("/", "_") for g in V.OCCUPANCY_GROUPS) + " progocc_diversity"
SCALE_COLS = "sad_area_km2 buildings_inside_count"
M1_COLS = " ".join([MORPH_COLS, PROG_COLS, ANCH_COLS, PEOPLE_COLS, OCC_COLS, LEVEL_COLS, CONN_COLS, SCALE_COLS])
W = "sum({c} * overlap_ratio)"
MEAN = ("coalesce(sum(CASE WHEN {c} <> -666666666 AND total_pop * overlap_ratio > 0 THEN {c} * total_pop * overlap_ratio END) / "
        "sum(CASE WHEN {c} <> -666666666 AND total_pop * overlap_ratio > 0 THEN total_pop * overlap_ratio END), 0)")
BANDS = {
    "homes": f"""SELECT district_id, 100.0 * sum(CASE WHEN tag IN {QUOTED(V.RESIDENTIAL_BUILDING_TAGS)} THEN area_m2 ELSE 0 END)
        / sum(area_m2) AS pct FROM bld_zone WHERE zone = 'interior' GROUP BY 1""",
    "prog": "SELECT district_id, " + ", ".join(
        f"coalesce(h.pct, max(interior_pct) FILTER (WHERE program = '{b}')) AS prog_pct_{b}" if b == "residential" else
        f"max(interior_pct) FILTER (WHERE program = '{b}') AS prog_pct_{b}" for b in B)
    + """, coalesce(sum(CASE WHEN interior_pct > 0 THEN -(interior_pct / t) * ln(interior_pct / t + 1e-12) END), 0)
        AS prog_diversity FROM (SELECT *, sum(interior_pct) OVER (PARTITION BY district_id) AS t FROM contrast) c
      LEFT JOIN homes h USING (district_id) GROUP BY district_id, h.pct""",
    "people": f"""SELECT district_id, pop / (darea / 1e6) AS demo_population_density, demo_median_age, demo_median_hh_income,
        demo_median_home_value, demo_pct_bachelors_plus, demo_unemployment_rate,
        (SELECT -sum(v / t * ln(v / t + 1e-12)) FROM (SELECT v, sum(v) OVER () AS t FROM (SELECT unnest([rw, rb, ra, rh,
          greatest(0, rt - rw - rb - ra)]) AS v) u WHERE v > 0) q) AS demo_racial_diversity
      FROM (SELECT district_id, {W.format(c='total_pop')} AS pop, {MEAN.format(c='median_age')} AS demo_median_age,
        {MEAN.format(c='median_household_income')} AS demo_median_hh_income, {MEAN.format(c='median_home_value')} AS demo_median_home_value,
        coalesce(({' + '.join(W.format(c='edu_' + e) for e in ('bachelors', 'masters', 'professional', 'doctorate'))})
          / nullif({W.format(c='edu_total_pop_25plus')}, 0), 0) * 100 AS demo_pct_bachelors_plus,
        coalesce({W.format(c='unemployed')} / nullif({W.format(c='labor_force')}, 0), 0) * 100 AS demo_unemployment_rate,
        {W.format(c='race_white')} AS rw, {W.format(c='race_black')} AS rb, {W.format(c='race_asian')} AS ra,
        {W.format(c='hispanic')} AS rh, {W.format(c='race_total')} AS rt FROM wunits WHERE overlap_ratio > 0 GROUP BY 1) s
      JOIN darea_t USING (district_id)""",
    "ob": OCC_OF.replace("FROM buildings", "FROM bld_zone WHERE zone = 'interior'"),
    "occ": f"""SELECT district_id, {', '.join(
        f"100 * sum(CASE WHEN grp = '{g}' THEN area_m2 ELSE 0 END) / sum(area_m2) AS progocc_pct_{g.replace('/', '_')}"
        for g in V.OCCUPANCY_GROUPS)}, any_value(h) AS progocc_diversity
      FROM ob JOIN (SELECT district_id, sum(-p * ln(p)) AS h FROM (SELECT district_id, grp,
        sum(area_m2) / sum(sum(area_m2)) OVER (PARTITION BY district_id) AS p FROM ob GROUP BY 1, 2) q GROUP BY 1) e
      USING (district_id) GROUP BY 1""",
    "scale": """SELECT district_id, darea / 1e6 AS sad_area_km2, coalesce(n, 0) AS buildings_inside_count FROM darea_t
      LEFT JOIN (SELECT district_id, count(*) AS n FROM bld_zone WHERE zone = 'interior' GROUP BY 1) b USING (district_id)""",
    "vec": f"""SELECT d.district_id, {', '.join(M1_COLS.split())} FROM districts d LEFT JOIN morph USING (district_id)
      LEFT JOIN prog USING (district_id) LEFT JOIN anch USING (district_id) LEFT JOIN people USING (district_id)
      LEFT JOIN occ USING (district_id) LEFT JOIN level USING (district_id) LEFT JOIN conn USING (district_id)
      LEFT JOIN scale USING (district_id)"""}
M1_EX = {**UNIT_EXTRA, **CONN_EX, "morph": MORPH, "contrast": CONTRAST, "anch": ANCH, "level": LEVEL, **BANDS}


def district_features(L):
    """M1: all bands of one row per district."""
    zb = zoned_buildings(L).where("zone = 'interior'").select(
        "district_id", "building_id", "area_m2", "perimeter_m", "orientation_deg", "cluster_id", "tag")
    code = F.element_at(F.array(*[F.lit(v) for v in ("RES1", "RES4", "COM1", "COM4", "COM8", "IND1", "GOV1")]),
                        (F.col("building_id") % 7 + 1).cast("int"))
    km2 = area_km2(L)
    prog = features.program_band(programs.interior_exterior(zoned_places(L))).withColumnRenamed("prog_pct_residential", "_places")
    prog = prog.join(features.residential_footprint(zb, "tag"), "district_id", "left").withColumn(
        "prog_pct_residential", F.coalesce("prog_pct_residential", "_places")).drop("_places")
    units = weighted_units(L)
    level = census.level_and_trend(L.view("panel"), L.view("districts").select("district_id", (F.col("radius") / 1000).alias("area_km2")))
    return features.assemble(L.view("districts").select("district_id"), [
        programs.morphology(zb, district_area(L)), prog,
        programs.anchor_features(zb.where("area_m2 > 4000"), zb, L.view("districts")),
        features.demographic_band(units, "overlap_ratio", km2).drop("demo_pct_owner_occupied"),
        programs.occupancy_mix(zb.withColumn("occupancy_group", C.occupancy_group(code))), level, connectivity(L),
        features.scale_band(zb, km2)])


@query("m1_district_features", "SELECT * FROM vec", M1_COLS.replace(" buildings_inside_count", ""), extra=M1_EX)
def _(L):
    return district_features(L).select("district_id", *M1_COLS.split())


@query("m26_thematic_axes", " UNION ALL ".join(
    f"SELECT '{name}' AS chart, district_id, {x}::double AS x, {y}::double AS y FROM vec"
    for name, (x, y) in V.THEMATIC_CHARTS.items()), "x y", extra=M1_EX)
def _(L):
    axes = dict.fromkeys(c for pair in V.THEMATIC_CHARTS.values() for c in pair)
    f = district_features(L).select("district_id", *[F.col(c).cast("double").alias(c) for c in axes])
    return features.thematic_axes(f, V.THEMATIC_CHARTS)


# --- M9 -----------------------------------------------------------------------------------------

TEN = V.DEMOGRAPHIC_FEATURES
LOGGED = lambda c: f"ln(1 + {c})" if c in V.LOG_DEMOGRAPHICS else c
SHARED = " + ".join(f"(q.{c} IS NOT NULL AND c.{c} IS NOT NULL)::INT" for c in TEN)


@query("m9_demographic_rank", f"""
    SELECT id, neighbor, distance, dims, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY distance, neighbor) AS r FROM (SELECT q.district_id AS id, c.district_id AS neighbor,
        round(sqrt(({' + '.join(f'coalesce(pow(q.{c} - c.{c}, 2), 0)' for c in TEN)}) / nullif({SHARED}, 0)), 6) AS distance,
        CAST({SHARED} AS BIGINT) AS dims FROM zq q, zc c) d WHERE dims > 0) z WHERE r <= 8""", "distance", extra={
    "wunits": "SELECT * FROM units", "demo": demo_sql("1"),
    "known": "SELECT district_id, " + ", ".join(
        f"CASE WHEN district_id % 9 <> 4 THEN {c} END AS {c}" if c == "unemployment_rate" else
        f"CASE WHEN district_id % 7 <> 3 THEN {c} END AS {c}" if c.startswith("pct_") and c != "pct_renter_occupied" else c
        for c in TEN) + " FROM demo",
    "asked_d": "SELECT district_id + 1000 AS district_id, " + ", ".join(
        f"CASE WHEN district_id % 4 <> 1 THEN {c} END AS {c}" if c == "estimated_population" else
        f"{c} * 1.1 AS {c}" if c == "median_household_income_pop_weighted" else c for c in TEN) + " FROM known",
    "stt": "SELECT " + ", ".join(
        f"CASE WHEN count({c}) >= greatest(3, count(*) // 2) THEN avg({LOGGED(c)}) END AS m_{c}, stddev_pop({LOGGED(c)}) AS s_{c}"
        for c in TEN) + " FROM known",
    **{z: "SELECT district_id, " + ", ".join(
        f"({LOGGED(c)} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END AS {c}" for c in TEN) + f" FROM {t}, stt"
       for z, t in (("zc", "known"), ("zq", "asked_d"))}})
def _(L):
    d = census.demographics(L.view("units").withColumn("one", F.lit(1.0)), "one").select("district_id", *TEN)
    there = lambda c, n, k: F.when(F.col("district_id") % n != k, F.col(c))
    known = d.withColumns({"unemployment_rate": there("unemployment_rate", 9, 4), **{
        c: there(c, 7, 3) for c in TEN if c.startswith("pct_") and c != "pct_renter_occupied"}})
    asked = known.withColumns({"estimated_population": there("estimated_population", 4, 1), "median_household_income_pop_weighted":
                               F.col("median_household_income_pop_weighted") * 1.1, "district_id": F.col("district_id") + 1000})
    return sim.rank_demographics(asked, known, "district_id", TEN, V.LOG_DEMOGRAPHICS)


# --- A43 ----------------------------------------------------------------------------------------

SCOPES = (("district", "district_id", "wunits"), ("municipal", "city", "cunits"), ("metro", "region", "cunits"))
SCOPE_SQL = " UNION ALL ".join(
    f"SELECT '{scope}' AS scope, CAST({key} AS VARCHAR) AS id, * EXCLUDE ({key}) FROM ("
    + demo_sql("overlap_ratio" if table == "wunits" else "1").replace("district_id", key).replace("wunits", table) + ") q"
    for scope, key, table in SCOPES)


@query("a43_scope_records", SCOPE_SQL, DEMO_COLS, extra={
    **UNIT_EXTRA, "cunits": "SELECT u.*, d.city, d.region FROM units u JOIN districts d USING (district_id)"})
def _(L):
    u = L.view("units").withColumn("one", F.lit(1.0)).join(L.view("districts").select("district_id", "city", "region"), "district_id")
    out = None
    for scope, key, table in SCOPES:
        rows, weight = (weighted_units(L), "overlap_ratio") if table == "wunits" else (u, "one")
        part = census.demographics(rows, weight, (key,)).withColumn("scope", F.lit(scope)).withColumn(
            "id", F.col(key).cast("string")).drop(key)
        out = part if out is None else out.unionByName(part)
    return out


# --- R8 -----------------------------------------------------------------------------------------

LOG1 = lambda c: f"ln(1 + greatest({c}, 0))"
SIGNED = lambda v: f"(CASE WHEN ({v}) < 0 THEN -1 ELSE 1 END * log10(abs({v}) + 1e-12))"
HU1, HU2 = "-log10((a * a + b * b) / (12 * a * b) + 1e-30)", "-log10(pow((a * a - b * b) / (12 * a * b), 2) + 1e-30)"
SHAPES = {
    "area_m2": LOG1("z.area_m2"), "perimeter_m": LOG1("z.perimeter_m"), "equivalent_diameter_m": LOG1("sqrt(4 * z.area_m2 / pi())"),
    "max_diameter_m": LOG1("5 * sqrt(a * a + b * b)"), "mrr_long_side_m": LOG1("5 * greatest(a, b)"),
    "mrr_short_side_m": LOG1("5 * least(a, b)"), "compactness": "4 * pi() * z.area_m2 / pow(z.perimeter_m, 2)", "hull_ratio": "1.0",
    "solidity": "z.area_m2 / (bw * bh)", "roughness": "1.0", "bbox_elongation": "greatest(bw, bh) / least(bw, bh)",
    "mrr_elongation": "greatest(a, b) / least(a, b)", "eccentricity": "sqrt(1 - pow(least(a, b) / greatest(a, b), 2))",
    "vertex_count": "4.0", "hu_1": SIGNED(HU1), "hu_2": f"CASE WHEN a <> b THEN {SIGNED(HU2)} ELSE 0 END",
    **{f"hu_{i}": "0.0" for i in range(3, 8)}}  # a rectangle is symmetric
R8_COLS = " ".join([*(f"shape__{c}" for c in V.SHAPE_FEATURES), *(f"prog__{b}" for b in B), "prog__count_inside_log",
                    *(f"prog_adj__{b}" for b in B), "prog_adj__count_adjacent_log", *(f"demo__{c}" for c in V.NODE_DEMOGRAPHICS),
                    "demo__present", "zone__interior"])
MIX = lambda where: "SELECT building_id, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (WHERE program = '{b}') / count(*) AS {b}" for b in B) + f" FROM place_bld WHERE {where} GROUP BY 1"
PERSON = lambda c: ("CASE WHEN u.median_household_income <> -666666666 THEN u.median_household_income END"
                    if c == "median_household_income" else f"u.{c}")


@query("r8_node_features", f"""
    SELECT z.building_id, {', '.join(f'({SHAPES[c]})::double AS shape__{c}' for c in V.SHAPE_FEATURES)},
      {', '.join(f'coalesce(i.{b}, 0)::double AS prog__{b}' for b in B)}, ln(1 + coalesce(i.n, 0)) AS prog__count_inside_log,
      {', '.join(f'coalesce(a1.{b}, 0)::double AS prog_adj__{b}' for b in B)}, ln(1 + coalesce(a1.n, 0)) AS prog_adj__count_adjacent_log,
      {', '.join(f'coalesce({PERSON(c) if c == "median_age" else LOG1(PERSON(c))}, 0)::double AS demo__{c}' for c in V.NODE_DEMOGRAPHICS)},
      CASE WHEN u.unit_id IS NULL THEN 0.0 ELSE 1.0 END::double AS demo__present,
      CASE WHEN z.zone = 'interior' THEN 1.0 ELSE 0.0 END::double AS zone__interior
    FROM bld_zone z JOIN (SELECT building_id, a, b, greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3) AS bw,
      greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) AS bh FROM buildings0) s USING (building_id)
    LEFT JOIN inside_mix i USING (building_id) LEFT JOIN near_mix a1 USING (building_id)
    LEFT JOIN units u ON u.district_id = z.district_id AND u.ux <= cx AND cx < u.ux + 250 AND u.uy <= cy AND cy < u.uy + 250""",
       R8_COLS, extra={"inside_mix": MIX("inside"), "near_mix": MIX("dist <= 10")})
def _(L):
    b = zoned_buildings(L)
    shaped = programs.add_hull_measures(programs.add_shape_measures(b))
    people = L.units().withColumn("median_household_income", null_if_sentinel("median_household_income"))
    people = spatial.transfer_first(b, people, "building_id", "unit_id", V.NODE_DEMOGRAPHICS)
    e = programs.building_programs(shaped, L.places()).join(people.select("building_id", *V.NODE_DEMOGRAPHICS), "building_id")
    return features.node_features(e, V.SHAPE_FEATURES, V.NODE_DEMOGRAPHICS).drop("district_id")
