"""District layers derived from the supplied tables.

A district is a run of neighbouring keys, so the number of districts grows with the data and
a district keeps a bounded size (30 places, 40 footprints, about 300 structures and 1200
job, pixel or street rows). Every derivation is integer arithmetic on keys, stated once as
SQL that both engines read: {div} is integer division, {str} the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.session import spread_scan, worked_out

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def pick(values, index: str) -> str:
    """SQL that picks a literal by position; None is NULL."""
    quote = lambda v: ("NULL" if v is None else "'%s'" % v if isinstance(v, str) else str(v))
    arms = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


LEAVES = ["restaurant", "coffee_shop", "hotel", "parking_garage", "stadium_arena", "park",
          "law_office", "apartment", "museum", "clothing_store", "gym", "hospital",
          "elementary_school", "bus_station", "bank_branch", "dog_park", "housing_authority",
          "casino", "motel", "software_company", "sports_bar", "church", "subway_station",
          "household_goods_store"]
TOPS = ["food_and_drink", "food_and_drink", "lodging", "travel_and_transportation",
        "sports_and_recreation", "geographic_entities", "services_and_business",
        "services_and_business", "arts_and_entertainment", "shopping",
        "sports_and_recreation", "health_care", "education", "travel_and_transportation",
        "services_and_business", None, "community_and_government", "arts_and_entertainment",
        "lodging", "services_and_business", "food_and_drink", "cultural_and_historic",
        "travel_and_transportation", "shopping"]
OCC = ["RES1-1SNB", "RES3A", "RES4", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM8",
       "COM9", "COM10", "IND1", "AGR1", "REL1", "GOV1", "EDU1"]
ROADS = ["primary", "secondary", "residential", "footway", "service", "motorway", "tertiary",
         "unclassified"]
COVER = [10, 30, 50, 50, 60, 80]

VIEWS = {
    "districts": f"""
        SELECT d.district_id, d.radius, n_name AS city, r_name AS region, d.nk,
          {pick(V.TYPOLOGIES, "d.nk % 4")} AS typology,
          CASE WHEN (d.nk {{div}} 4) % 4 <> d.nk % 4
               THEN {pick(V.TYPOLOGIES, "(d.nk {div} 4) % 4")} END AS secondary,
          CASE WHEN d.district_id < 10 THEN '0' ELSE '' END || CAST(d.district_id AS {{str}})
            || '_' || n_name || '-District_City' || CAST(d.nk AS {{str}}) || '-'
            || {pick(["TX", "ON", "MI", "BC", "CA"], "d.district_id % 5")} AS code
        FROM (SELECT s_suppkey {{div}} 2 AS district_id, min(s_nationkey) AS nk,
                CAST(300 + ((s_suppkey {{div}} 2) * 37) % 120 AS double) AS radius
              FROM {{supplier}} GROUP BY s_suppkey {{div}} 2) d
        JOIN {{nation}} ON n_nationkey = d.nk JOIN {{region}} ON r_regionkey = n_regionkey""",
    "places": f"""
        SELECT c_custkey AS place_id, c_custkey {{div}} 30 AS district_id,
          CAST((c_custkey * 7919) % 1000 AS double) + 0.25 AS x,
          CAST((c_custkey * 104729) % 1000 AS double) + 0.25 AS y,
          {pick(LEAVES, "(c_custkey * 31) % 24")} AS leaf,
          {pick(TOPS, "(c_custkey * 31) % 24")} AS top_level,
          CASE WHEN c_custkey % 20 = 0 THEN '' ELSE 'P' || CAST(c_custkey % 7 AS {{str}}) END
            AS name,
          CAST((c_custkey * 13) % 100 AS double) / CAST(100 AS double) AS confidence,
          CASE WHEN c_custkey % 17 = 0 THEN 'True' ELSE '0' END AS is_duplicate,
          CASE WHEN (c_custkey {{div}} 30) % 3 = 0 THEN 'false'
               WHEN c_custkey % 9 = 0 THEN 'no' ELSE 'Yes' END AS is_operational,
          c_mktsegment AS segment
        FROM {{customer}}""",
    "buildings0": f"""
        SELECT b.*, x0 + a * dx AS x1, y0 + a * dy AS y1,
          x0 + a * dx - b * dy AS x2, y0 + a * dy + b * dx AS y2,
          x0 - b * dy AS x3, y0 + b * dx AS y3
        FROM (SELECT p_partkey AS building_id, p_partkey {{div}} 40 AS district_id, p_name AS name,
            CAST((p_partkey * 6151) % 900 AS double) AS x0,
            CAST((p_partkey * 3079) % 900 AS double) AS y0,
            CAST((2 + p_size {{div}} 5) * CASE WHEN p_partkey % 20 = 7 THEN 4 ELSE 1 END
                 AS double) AS a,
            CAST((2 + (p_partkey % 60) {{div}} 5) * CASE WHEN p_partkey % 20 = 7 THEN 4 ELSE 1 END
                 AS double) AS b,
            CAST({pick([5, 3, 4, 0], "p_partkey % 4")} AS double) AS dx,
            CAST({pick([0, 4, 3, 5], "p_partkey % 4")} AS double) AS dy,
            CASE p_type WHEN 'ECONOMY' THEN 'apartments' WHEN 'SMALL' THEN 'house'
              WHEN 'MEDIUM' THEN 'office' WHEN 'LARGE' THEN 'stadium'
              WHEN 'PROMO' THEN 'retail' ELSE 'yes' END AS tag,
            1 + p_partkey % 5 AS cluster_id, p_size AS size_code
          FROM {{part}}) b""",
    "structures": f"""
        SELECT o_orderkey AS structure_id, o_custkey {{div}} 30 AS district_id,
          CAST((o_orderkey * 7919) % 1000 AS double) + 0.5 AS x,
          CAST((o_orderkey * 104729) % 1000 AS double) + 0.5 AS y,
          {pick(OCC, "o_orderkey % 17")} AS occtype,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL
               ELSE CAST(500 + 10 * (o_orderkey % 900) AS double) END AS sqft,
          CAST(1 + o_orderkey % 12 AS double) AS num_story,
          CAST(1880 + o_orderkey % 140 AS int) AS med_yr_blt
        FROM {{orders}}""",
    "poi_dump": """
        SELECT o_orderkey AS poi_id, o_custkey {div} 30 AS district_id,
          'N' || CAST(o_orderkey % 5 AS {str}) AS name,
          CAST((o_orderkey * 7919) % 200 AS double) AS x,
          CAST((o_orderkey * 104729) % 200 AS double) AS y
        FROM {orders}""",
    "units": """
        SELECT district_id, unit_no, district_id * 16 + unit_no AS unit_id,
          CAST(250 * (unit_no % 4) AS double) AS ux, CAST(250 * (unit_no {div} 4) AS double) AS uy,
          total_pop, CASE WHEN unit_no = 5 THEN CAST(-666666666 AS double) ELSE income END
            AS median_household_income,
          median_age, home_value AS median_home_value, rent AS median_gross_rent,
          owner AS owner_occupied, renter AS renter_occupied, owner + renter AS occupied_total,
          total_pop - low AS edu_total_pop_25plus, urgent AS edu_bachelors,
          high AS edu_masters, medium AS edu_professional, notspec AS edu_doctorate,
          total_pop AS race_total, race0 AS race_white, race1 AS race_black,
          race2 AS race_asian, race3 AS hispanic, renter AS labor_force, low AS unemployed
        FROM (SELECT o_custkey {div} 30 AS district_id, (o_orderkey {div} 7) % 16 AS unit_no,
            CAST(count(*) AS double) AS total_pop, avg(o_totalprice) AS income,
            avg(CAST(20 + o_orderkey % 60 AS double)) AS median_age,
            max(o_totalprice) AS home_value, min(o_totalprice) AS rent,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS double) AS owner,
            CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS double) AS renter,
            CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS double) AS urgent,
            CAST(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS double) AS high,
            CAST(sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS double) AS medium,
            CAST(sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS double)
              AS notspec,
            CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS double) AS low,
            CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS double) AS race0,
            CAST(sum(CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END) AS double) AS race1,
            CAST(sum(CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END) AS double) AS race2,
            CAST(sum(CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END) AS double) AS race3
          FROM {orders} GROUP BY o_custkey {div} 30, (o_orderkey {div} 7) % 16) u""",
    "panel": """
        SELECT district_id, yr, pop, income, home_value, rent,
          100.0e0 * owner / nullif(owner + renter, 0) AS pct_owner,
          100.0e0 * renter / nullif(owner + renter, 0) AS pct_renter,
          100.0e0 * urgent / pop AS pct_bachelors
        FROM (SELECT o_custkey {div} 30 AS district_id, CAST(year(o_orderdate) AS int) AS yr,
            CAST(count(*) AS double) AS pop, avg(o_totalprice) AS income,
            max(o_totalprice) AS home_value, min(o_totalprice) AS rent,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS double) AS owner,
            CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS double) AS renter,
            CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS double) AS urgent
          FROM {orders} GROUP BY o_custkey {div} 30, CAST(year(o_orderdate) AS int)) p""",
    "jobs_long": """
        SELECT l_suppkey {div} 2 AS district_id, l_partkey % 16 AS block_no,
          CAST(year(l_shipdate) AS int) AS yr, CAST(l_partkey % 20 AS int) AS sector,
          CAST(l_linenumber % 3 AS int) AS band, l_quantity AS jobs
        FROM {lineitem}""",
    "stop_times": """
        SELECT 'F' || CAST((event_id {div} 10) % 4 AS {str}) AS feed_id, user_id AS stop_id,
          user_id {div} 3 AS district_id, event_id {div} 10 AS trip_id, event_id AS seq,
          (event_id {div} 10) % 12 AS route_id, (event_id {div} 10) % 5 AS service_id,
          CAST(hour(ts) AS bigint) * 3600 + CAST(minute(ts) AS bigint) * 60
            + CAST(floor(second(ts)) AS bigint) AS dep_s,
          CAST(ts AS date) AS day, event_type, value,
          CAST((user_id * 7919) % 1000 AS double) + 0.25 AS x,
          CAST((user_id * 104729) % 1000 AS double) + 0.25 AS y
        FROM {events}""",
    "streets": f"""
        SELECT s.*, i2 + 8 * j2 AS v, least(u, i2 + 8 * j2) AS lo, greatest(u, i2 + 8 * j2) AS hi,
          {pick(ROADS, "(least(u, i2 + 8 * j2) * 3 + greatest(u, i2 + 8 * j2) * 2) % 8")} AS highway,
          CAST(i * 120 AS double) AS x1, CAST(j * 120 AS double) AS y1,
          CAST(i2 * 120 AS double) AS x2, CAST(j2 * 120 AS double) AS y2
        FROM (SELECT t.*, CASE WHEN d = 0 THEN CASE WHEN i < 7 THEN i + 1 ELSE i - 1 END ELSE i END
                AS i2,
              CASE WHEN d = 1 THEN CASE WHEN j < 7 THEN j + 1 ELSE j - 1 END ELSE j END AS j2
            FROM (SELECT l_suppkey {{div}} 2 AS district_id, l_partkey % 64 AS u,
                (l_partkey % 64) % 8 AS i, (l_partkey % 64) {{div}} 8 AS j, l_orderkey % 2 AS d,
                110 + l_quantity AS length_m,
                CASE WHEN l_linenumber % 3 = 0 THEN 4.0e0 END AS lanes
              FROM {{lineitem}}) t) s""",
    "parcels": """
        SELECT o_orderkey AS parcel_id, o_custkey {div} 30 AS district_id,
          o_totalprice / 50000 AS acres,
          'Owner ' || CAST(o_custkey % 15 AS {str}) AS owner, o_orderpriority AS zoning,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'use ' || o_orderstatus END AS usedesc,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'alt ' || o_orderstatus END AS use_alt,
          CAST(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 1880 + (o_orderkey * 7) % 140 END AS int)
            AS year_built,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL
               ELSE CAST(800 + (o_orderkey * 37) % 9000 AS double) END AS bldg_sqft,
          CASE WHEN o_orderkey % 10 = 0 THEN 'Y' ELSE '' END AS exemption,
          CAST(1000 + (o_orderkey * 91) % 90000 AS double) AS land_value,
          CASE WHEN o_orderkey % 6 = 0 THEN CAST(0 AS double)
               ELSE CAST(5000 + (o_orderkey * 53) % 70000 AS double) END AS bldg_value
        FROM {orders}""",
    "pixels": f"""
        SELECT p.*, CAST(col_no * 50 + 25 AS double) AS x, CAST(row_no * 50 + 25 AS double) AS y,
          CAST({pick(COVER, "(row_no {div} 5 + col_no {div} 5 + district_id) % 6")} AS int) AS cover
        FROM (SELECT l_suppkey {{div}} 2 AS district_id, l_orderkey % 20 AS row_no,
            l_partkey % 20 AS col_no, CAST(month(l_shipdate) AS int) AS scene_month,
            CAST(year(l_shipdate) * 100 + month(l_shipdate) AS int) AS scene,
            CASE WHEN (l_partkey + l_orderkey) % 13 = 0 THEN CAST(0 AS double) ELSE
              CAST(30000 + (l_partkey * 31 + l_orderkey * 17) % 15000 AS double) END AS dn,
            CAST(8000 + (l_partkey * 7) % 3000 AS double) AS red,
            CAST(9000 + (l_orderkey * 11) % 8000 AS double) AS nir,
            l_quantity AS cloud
          FROM {{lineitem}}) p""",
}

# Layers whose columns are cases of cases: pushed below, a filter would hold each case many times over.
NESTED = ("streets",)


def spark_text(name: str) -> str:
    return VIEWS[name].replace("{div}", "div").replace("{str}", "STRING")


def duck_text(name: str) -> str:
    text = VIEWS[name].replace("{div}", "//").replace("{str}", "VARCHAR")
    for table in TABLES:
        text = text.replace("{%s}" % table, table)
    return text


# Corners of the octagonal boundary as (x, y) in terms of radius r and its 7/10 part h.
OCTAGON = [("500 + r", "500"), ("500 + h", "500 + h"), ("500", "500 + r"), ("500 - h", "500 + h"),
           ("500 - r", "500"), ("500 - h", "500 - h"), ("500", "500 - r"), ("500 + h", "500 - h")]


class Layers:
    """District layers of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._seen = spark, sf_dir.rstrip("/"), {}
        # inferring constraints from long geometry expressions takes longer than most queries
        spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
        # estimates do not see that a polygon becomes edges, tiles and cells, and a plan has dozens of joins whose tables the
        # driver would hold at once: only what a query names as small is broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")

    def table(self, name: str) -> DataFrame:
        if name not in self._seen:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            # the geometry of these layers is heavy per row
            self._seen[name] = spread_scan(df) if name in ("lineitem", "part", "customer") else df
        return self._seen[name]

    def view(self, name: str) -> DataFrame:
        if f"v_{name}" not in self._seen:
            text = spark_text(name)
            used = {t: self.table(t) for t in TABLES if "{%s}" % t in text}
            df = self.spark.sql(text, **used)
            if name in NESTED:
                df = worked_out(df)
            self._seen[f"v_{name}"] = df
        return self._seen[f"v_{name}"]

    def boundaries(self) -> DataFrame:
        d = self.view("districts").withColumn("h", F.floor(F.col("radius") * 7 / 10).cast("double"))
        corners = [(F.expr(x.replace("r", "radius")), F.expr(y.replace("r", "radius")))
                   for x, y in OCTAGON]
        ring = geo.ring_from(*corners, corners[0])
        return (d.withColumn("rings", F.array(ring))
                .withColumn("edges", geo.edges("rings")).drop("h", "nk"))

    def buildings(self) -> DataFrame:
        if "buildings" not in self._seen:
            self._seen["buildings"] = self._buildings()
        return self._seen["buildings"]

    def _buildings(self) -> DataFrame:
        b = self.view("buildings0")
        ring = geo.ring_from(("x0", "y0"), ("x1", "y1"), ("x2", "y2"), ("x3", "y3"), ("x0", "y0"))
        return worked_out(b.withColumn("rings", F.array(ring)).withColumn("edges", geo.edges("rings"))
                .withColumn("area_m2", geo.area("rings"))
                .withColumn("perimeter_m", geo.perimeter("rings"))
                .withColumn("centre", geo.centroid("rings"))
                .withColumn("cx", F.col("centre.x")).withColumn("cy", F.col("centre.y"))
                .withColumn("orientation_deg", F.when(F.col("a") >= F.col("b"), F.degrees(
                    F.atan2("dy", "dx"))).otherwise(F.pmod(F.degrees(F.atan2("dy", "dx")) + 90,
                                                           F.lit(180.0))))
                .select("building_id", "district_id", "name", "tag", "cluster_id", "rings", "edges",
                        "area_m2", "perimeter_m", "cx", "cy", "orientation_deg", "size_code"))

    def places(self) -> DataFrame:
        from townloom.functions.classify import bucket_with_top_level

        return self.view("places").withColumn("program", bucket_with_top_level("leaf", "top_level"))

    def units(self) -> DataFrame:
        u = self.view("units")
        x1, y1 = F.col("ux") + 250, F.col("uy") + 250
        ring = geo.ring_from(("ux", "uy"), (x1, "uy"), (x1, y1), ("ux", y1), ("ux", "uy"))
        return u.withColumn("rings", F.array(ring)).withColumn("edges", geo.edges("rings"))


# --- the same layers for the reference SQL ----------------------------------------------------

_OCT_ROWS = " UNION ALL ".join(
    "SELECT district_id, {i} AS i, {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM bnd0".format(
        i=i, x1=OCTAGON[i][0], y1=OCTAGON[i][1], x2=OCTAGON[(i + 1) % 8][0],
        y2=OCTAGON[(i + 1) % 8][1]) for i in range(8))

EXTRA = {
    "bnd0": "SELECT district_id, radius AS r, floor(radius * 7 / 10) AS h FROM districts",
    "bnd": _OCT_ROWS,
    "bld_edges": " UNION ALL ".join(
        f"SELECT building_id, district_id, {i} AS i, x{i} AS x1, y{i} AS y1, x{(i + 1) % 4} AS x2,"
        f" y{(i + 1) % 4} AS y2 FROM buildings0" for i in range(4)),
    "buildings": """
        SELECT building_id, district_id, name, tag, cluster_id, 25 * a * b AS area_m2,
          10 * (a + b) AS perimeter_m, (x0 + x2) / 2 AS cx, (y0 + y2) / 2 AS cy, size_code,
          CASE WHEN a >= b THEN degrees(atan2(dy, dx))
               ELSE (CASE WHEN degrees(atan2(dy, dx)) + 90 >= 180
                     THEN degrees(atan2(dy, dx)) - 90 ELSE degrees(atan2(dy, dx)) + 90 END) END
            AS orientation_deg
        FROM buildings0""",
}


def program_case(leaf: str = "leaf", top: str = "top_level") -> str:
    """C1 as independent SQL for the reference queries."""
    inlist = lambda vs: "(" + ", ".join(f"'{v}'" for v in vs) + ")"
    tops = " ".join(f"WHEN {top} = '{k}' THEN '{v}'" for k, v in V.TOP_LEVEL_BUCKET.items())
    return (f"CASE WHEN {leaf} IN {inlist(V.PARKING_LEAVES)} THEN 'parking' "
            f"WHEN {leaf} IN {inlist(V.RESIDENTIAL_LEAVES)} THEN 'other' "
            f"WHEN {leaf} IN {inlist(V.HOTEL_LEAVES)} THEN 'hotel' "
            f"WHEN {leaf} IN {inlist(V.SPORT_LEAVES)} THEN 'sport' "
            f"WHEN {leaf} IN {inlist(V.OPEN_SPACE_LEAVES)} THEN 'open_space' "
            f"{tops} ELSE 'other' END")


CROSSES = ("((e.y1 > {y}) <> (e.y2 > {y})) AND {x} < (e.x2 - e.x1) * ({y} - e.y1) / "
           "(e.y2 - e.y1) + e.x1")
SEG_D2 = ("(({x} - (e.x1 + {t} * (e.x2 - e.x1))) * ({x} - (e.x1 + {t} * (e.x2 - e.x1))) + "
          "({y} - (e.y1 + {t} * (e.y2 - e.y1))) * ({y} - (e.y1 + {t} * (e.y2 - e.y1))))")


def crosses(x: str, y: str) -> str:
    """SQL: the edge e crosses the ray from (x, y)."""
    return CROSSES.format(x=x, y=y)


def seg_d2(x: str, y: str) -> str:
    """SQL: squared distance of (x, y) to the edge e."""
    t = (f"least(greatest((({x}) - e.x1) * (e.x2 - e.x1) + (({y}) - e.y1) * (e.y2 - e.y1), 0) / "
         "((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)), 1)")
    return SEG_D2.format(x=f"({x})", y=f"({y})", t=t)


EXTRA["places_p"] = f"SELECT *, {program_case()} AS program FROM places"
EXTRA["place_zone"] = f"""
    SELECT p.place_id, p.district_id, p.program, p.x, p.y, p.leaf,
      CASE WHEN count(*) FILTER (WHERE {crosses('p.x', 'p.y')}) % 2 = 1
           THEN 'interior' ELSE 'exterior' END AS zone
    FROM places_p p JOIN bnd e ON e.district_id = p.district_id
    GROUP BY ALL"""
EXTRA["bld_zone"] = f"""
    SELECT b.building_id, b.district_id, b.tag, b.cluster_id, b.area_m2, b.perimeter_m,
      b.cx, b.cy, b.orientation_deg, b.name, b.size_code,
      CASE WHEN count(*) FILTER (WHERE {crosses('b.cx', 'b.cy')}) % 2 = 1
           THEN 'interior' ELSE 'exterior' END AS zone
    FROM buildings b JOIN bnd e ON e.district_id = b.district_id
    GROUP BY ALL"""
EXTRA["place_bld"] = f"""
    SELECT p.place_id, p.district_id, p.program, e.building_id,
      count(*) FILTER (WHERE {crosses('p.x', 'p.y')}) % 2 = 1 AS inside,
      CASE WHEN count(*) FILTER (WHERE {crosses('p.x', 'p.y')}) % 2 = 1 THEN 0.0
           ELSE sqrt(min({seg_d2('p.x', 'p.y')})) END AS dist
    FROM places_p p JOIN bld_edges e ON e.district_id = p.district_id
    GROUP BY ALL"""
ORDER = list(VIEWS) + ["bnd0", "bnd", "bld_edges", "buildings", "places_p", "place_zone",
                       "bld_zone", "place_bld"]


def duck_sql(body: str, doubles: str = "", extra: dict | None = None) -> str:
    """A reference query: the layers it mentions as CTEs, its body, doubles rounded."""
    import re

    texts = {n: duck_text(n) for n in VIEWS} | EXTRA | (extra or {})
    order = ORDER + [k for k in (extra or {})]
    used, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in texts:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                todo.append(texts[name])
    ctes = [f"{n} AS ({texts[n]})" for n in order if n in used]
    ctes.append(f"answer AS ({body})")
    replace = ", ".join(f"round({c} + 1.1e-7, 4) + 0.0 AS {c}" for c in doubles.split())
    tail = f"SELECT * REPLACE ({replace}) FROM answer" if replace else "SELECT * FROM answer"
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + tail


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison. The offset keeps exact ties off the rounding edge, where
    engines differ; adding 0.0 turns a negative zero into zero."""
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            df = df.withColumn(field.name, F.round(
                F.col(field.name).cast("double") + F.lit(1.1e-7), digits)
                               + F.lit(0.0))
    return df
