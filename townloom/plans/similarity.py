"""Queries for scaling, similarity, clustering and evaluation (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from townloom.functions import classify as C
from townloom.functions import vocab as V
from townloom.operators import census, clustering, programs, spatial
from townloom.operators import similarity as sim
from townloom.plans.aggregates import (ANCH, CONTRAST, DAREA, MORPH, PARCEL, STRUCT, district_area, zoned_buildings,
                                       zoned_places)
from townloom.plans.catalog import query
from townloom.plans.panels import LEVEL

B = V.BUCKETS
FEATS = ["pop", "rent", "age", "renter", "low"]
FSQL = ("SELECT district_id, sum(total_pop) AS pop, avg(median_gross_rent) AS rent, avg(median_age) AS age,"
        " sum(renter_occupied) AS renter, CASE WHEN district_id % 9 = 4 THEN NULL ELSE sum(unemployed) END AS low"
        " FROM units GROUP BY 1")


def features(L):
    return L.view("units").groupBy("district_id").agg(
        F.sum("total_pop").alias("pop"), F.avg("median_gross_rent").alias("rent"),
        F.avg("median_age").alias("age"), F.sum("renter_occupied").alias("renter"),
        F.sum("unemployed").alias("low")).withColumn(
        "low", F.when(F.col("district_id") % 9 != 4, F.col("low")))


def program_shares(L):
    n = F.count("*")
    return L.places().groupBy("district_id").agg(*[
        (F.count(F.when(F.col("program") == b, 1)) / n).alias(b) for b in B])


PSH = ("SELECT district_id, " + ", ".join(
    f"count(*) FILTER (WHERE program = '{b}') / count(*) AS {b}" for b in B) + " FROM places_p GROUP BY 1")


def structure_shares(L):
    s = L.view("structures").withColumn("bucket", C.occupancy_bucket("occtype"))
    area = F.coalesce(F.col("sqft"), F.lit(0.0))
    return s.groupBy("district_id").agg(*[
        (F.sum(F.when(F.col("bucket") == b, area).otherwise(0.0)) / F.sum(area)).alias(b) for b in B])


SSH = ("SELECT district_id, " + ", ".join(
    f"sum(CASE WHEN bucket = '{b}' THEN coalesce(sqft, 0) ELSE 0 END) / sum(coalesce(sqft, 0)) AS {b}"
    for b in B) + " FROM st GROUP BY 1")


def labels(L):
    d = L.view("districts")
    return d.select("district_id", F.when(F.col("district_id") % 8 != 5, F.col("typology")).alias("primary"),
                    "secondary", F.col("typology").alias("fallback"))


LAB = ("SELECT district_id, CASE WHEN district_id % 8 <> 5 THEN typology END AS primary1, secondary,"
       " typology AS fallback FROM districts")


def knn_sql(source: str, cols: list[str], k: int) -> str:
    """SQL: k nearest by RMS distance of population z-scores, NULL-free columns."""
    z = ", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN "
                  f"stddev_pop({c}) OVER () ELSE 1 END AS {c}" for c in cols)
    d = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in cols)
    return f"""SELECT id, neighbor, distance, CAST(r AS INTEGER) AS rank FROM (SELECT a.district_id AS id,
      b.district_id AS neighbor, round(sqrt(({d}) / {len(cols)}), 6) AS distance, row_number() OVER (
      PARTITION BY a.district_id ORDER BY round(sqrt(({d}) / {len(cols)}), 6), b.district_id) AS r
      FROM (SELECT district_id, {z} FROM {source}) a JOIN (SELECT district_id, {z} FROM {source}) b
      ON a.district_id <> b.district_id) q WHERE r <= {k}"""


@query("m2_zscore_sample", "SELECT district_id, " + ", ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 0) AS {c}" for c in FEATS)
    + ", 0.0::double AS flat FROM feats", " ".join(FEATS) + " flat", extra={"feats": FSQL})
def _(L):
    return sim.zscore_sample(features(L).withColumn("flat", F.lit(3.0)), FEATS + ["flat"])


@query("m3_zscore_population", "SELECT district_id, " + ", ".join(
    f"coalesce(round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4), 0) AS {c}" for c in FEATS)
    + " FROM feats", " ".join(FEATS), extra={"feats": FSQL})
def _(L):
    return sim.zscore_population(features(L), FEATS)


@query("m4_robust_scale", """
    SELECT building_id, least(greatest((area_m2 - m) / (h - l), -8), 8) AS area_m2,
      least(greatest((perimeter_m - pm) / (ph - pl), -8), 8) AS perimeter_m FROM buildings, (
      SELECT quantile_cont(area_m2, 0.25) AS l, median(area_m2) AS m, quantile_cont(area_m2, 0.75) AS h,
        quantile_cont(perimeter_m, 0.25) AS pl, median(perimeter_m) AS pm, quantile_cont(perimeter_m, 0.75) AS ph
      FROM buildings) q""", "area_m2 perimeter_m")
def _(L):
    b = L.buildings().select("building_id", "area_m2", "perimeter_m")
    return sim.robust_scale(b, ["area_m2", "perimeter_m"])


COS = """SELECT id, neighbor, distance, CAST(r AS INTEGER) AS rank FROM (SELECT a.vec_id AS id, b.vec_id AS neighbor,
      round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance, row_number() OVER (PARTITION BY a.vec_id
        ORDER BY round(1 - list_cosine_similarity(a.e, b.e), 6), b.vec_id) AS r
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a
    JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id) q WHERE r <= {k}"""


def vectors(L):
    return L.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"),
                                        "label")


@query("m5_cosine_neighbours", "SELECT * FROM cosn", "distance", extra={"cosn": COS.format(k=5)})
def _(L):
    return sim.nearest(vectors(L), 5, "vec_id", "vec", "cosine").drop("dims")


@query("m5_cosine_neighbours_pivoted", "SELECT * FROM cosn", "distance", extra={"cosn": COS.format(k=5)})
def _(L):
    return sim.nearest(vectors(L), 5, "vec_id", "vec", "cosine", pivots=8, block_rows=64).drop("dims")


@query("m5_cosine_to_focus", """
    SELECT f.district_id AS focus, d.district_id, 1 - (f.pop * d.pop + f.rent * d.rent + f.age * d.age) / (
      sqrt(f.pop * f.pop + f.rent * f.rent + f.age * f.age) * sqrt(d.pop * d.pop + d.rent * d.rent + d.age * d.age))
      AS distance FROM feats d JOIN feats f ON f.pop > 320""", "distance", extra={"feats": FSQL})
def _(L):
    f = features(L)
    return sim.distances_to(f, f.where("pop > 320"), "district_id", ["pop", "rent", "age"])


@query("m6_principal_components")
def _(L):
    z = sim.zscore_sample(features(L), FEATS)
    return sim.principal_components(z, ["district_id"], FEATS)[0]


@query("m7_panel_components")
def _(L):
    return sim.panel_components(L.view("panel"), ["district_id", "yr"],
                                ["pop", "income", "pct_renter", "pct_bachelors"])[0]


ZF = "SELECT district_id, " + ", ".join(
    f"coalesce(round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4), 0) AS {c}" for c in FEATS) + " FROM feats"


@query("m8_distinguishing_features", f"""
    SELECT a, b, feature, a_z, b_z, d AS abs_diff, CAST(r AS INTEGER) AS rank FROM (SELECT x.id AS a, x.neighbor AS b,
      p.feature, p.v AS a_z, q.v AS b_z, round(abs(p.v - q.v), 9) AS d, row_number() OVER (PARTITION BY x.id, x.neighbor
        ORDER BY round(abs(p.v - q.v), 9) DESC, p.feature) AS r
      FROM near x JOIN lf p ON p.district_id = x.id JOIN lf q ON q.district_id = x.neighbor AND q.feature = p.feature) z
    WHERE r <= 3""", "a_z b_z abs_diff", extra={"feats": FSQL, "zf": ZF, "near": knn_sql("zf", FEATS, 2), "lf": f"""
    UNPIVOT zf ON {', '.join(FEATS)} INTO NAME feature VALUE v"""})
def _(L):
    z = sim.zscore_population(features(L), FEATS)
    near = sim.rank_shares(z, "district_id", FEATS, 2)
    pairs = near.select(F.col("id").alias("a"), F.col("neighbor").alias("b"))
    return sim.distinguishing(pairs, z, "district_id", FEATS, 3)


PKNN = {"psh": PSH, "pk": knn_sql("psh", B, 7)}


@query("m10_program_neighbours", "SELECT * FROM pk", "distance", extra=PKNN)
def _(L):
    return sim.rank_shares(program_shares(L), "district_id", B, 7).drop("dims")


@query("m10_structure_neighbours", "SELECT * FROM sk", "distance",
       extra={"st": STRUCT, "ssh": SSH, "sk": knn_sql("ssh", B, 5)})
def _(L):
    return sim.rank_shares(structure_shares(L), "district_id", B, 5).drop("dims")


TYP = ["entertainment", "community", "innovation", "sports_park"]
FIT = f"""SELECT id, {', '.join(f'round(100 * w{i} / (w0 + w1 + w2 + w3), 1) AS pct_{t}' for i, t in enumerate(TYP))}
    FROM (SELECT p.id, {', '.join(f"sum(CASE WHEN coalesce(primary1, fallback) = '{t}' THEN 1 / (distance + 0.001) ELSE 0 END + CASE WHEN secondary = '{t}' THEN 0.5 / (distance + 0.001) ELSE 0 END) AS w{i}" for i, t in enumerate(V.TYPOLOGIES))}
      FROM pk p JOIN lab l ON l.district_id = p.neighbor GROUP BY 1) q"""
FITX = {**PKNN, "lab": LAB, "fit": FIT, "fitted": "SELECT *, arg_min(t, (-p, i)) AS top_type FROM fit"}
TOPT = ("CASE greatest(pct_entertainment, pct_community, pct_innovation, pct_sports_park) WHEN pct_entertainment"
        " THEN 'Entertainment' WHEN pct_community THEN 'Community' WHEN pct_innovation THEN 'Innovation'"
        " ELSE 'Sports Park' END")
FITX = {**PKNN, "lab": LAB, "fit": FIT}


@query("m11_typology_fit", f"SELECT *, {TOPT} AS top_type FROM fit", " ".join(f"pct_{t}" for t in TYP),
       extra=FITX)
def _(L):
    near = sim.rank_shares(program_shares(L), "district_id", B, 7)
    return sim.typology_fit(near, labels(L), "district_id", V.TYPOLOGIES)


@query("m11_fit_reason", f"""
    SELECT id, coalesce(string_agg(replace(b, '_', ' ') || ' ' || CAST(round(v * 100) AS INTEGER) || '%', ', '
      ORDER BY v DESC, b), 'mixed program with no single dominant use') AS why FROM (SELECT id, {TOPT} AS t FROM fit) f
    LEFT JOIN (SELECT district_id, b, round(v, 3) AS v FROM (UNPIVOT psh ON {', '.join(B)} INTO NAME b VALUE v) u
      WHERE round(v, 3) > 0.02) s ON s.district_id = f.id AND b IN (SELECT unnest(CASE t
        WHEN 'Entertainment' THEN ['retail_food_entertainment', 'sport', 'hotel']
        WHEN 'Community' THEN ['residential', 'open_space', 'retail_food_entertainment']
        WHEN 'Innovation' THEN ['office', 'residential'] ELSE ['sport', 'parking', 'open_space'] END))
    GROUP BY 1""", extra=FITX)
def _(L):
    sh = program_shares(L)
    fit = sim.typology_fit(sim.rank_shares(sh, "district_id", B, 7), labels(L), "district_id",
                           V.TYPOLOGIES)
    return sim.fit_reason(sh, fit, "district_id")


@query("m12_suggested_type", """
    SELECT id, arg_min(label, (-round(v, 9), label)) AS label, max(v) / sum(v) AS confidence FROM (
      SELECT id, label, sum(1 / (distance + 0.05)) AS v FROM (SELECT p.id, p.distance, l.primary1 AS label,
          row_number() OVER (PARTITION BY p.id ORDER BY distance, neighbor) AS r FROM pk40 p
          JOIN lab l ON l.district_id = p.neighbor WHERE primary1 IS NOT NULL) q WHERE r <= 6 GROUP BY 1, 2) z
    GROUP BY 1""", "confidence", extra={"psh": PSH, "pk40": knn_sql("psh", B, 1000000), "lab": LAB})
def _(L):
    lab = labels(L).where("primary is not null").select("district_id", F.col("primary").alias("label"))
    near = sim.rank_shares(program_shares(L), "district_id", B, 6, lab)
    return sim.suggest_type(near, lab, "district_id")


RAW = f"""SELECT id, neighbor, distance FROM (SELECT a.district_id AS id, b.district_id AS neighbor,
      round(sqrt({' + '.join(f'pow(a.{b} - b.{b}, 2)' for b in B)}), 6) AS distance, row_number() OVER (
      PARTITION BY a.district_id ORDER BY round(sqrt({' + '.join(f'pow(a.{b} - b.{b}, 2)' for b in B)}), 6),
      b.district_id) AS r FROM psh a JOIN psh b ON a.district_id <> b.district_id) q WHERE r <= 3"""


@query("m13_neighbours_with_fallback", """
    SELECT id, neighbor, distance, 'distance' AS basis FROM pk WHERE rank <= 3 AND id IN (FROM known) UNION ALL
    SELECT id, neighbor, distance, 'shares' FROM raw WHERE id NOT IN (FROM known)""", "distance",
       extra={**PKNN, "raw": RAW, "lab": LAB, "known": "SELECT district_id FROM lab WHERE primary1 IS NOT NULL"})
def _(L):
    sh = program_shares(L)
    known = labels(L).where("primary is not null").select(F.col("district_id").alias("id"))
    first = sim.rank_shares(sh, "district_id", B, 3).join(known, "id", "left_semi")
    raw = sim.nearest(sh.select("district_id", F.array(*B).alias("vec")), 3, "district_id", "vec")
    return sim.with_fallback(first, raw).select("id", "neighbor", "distance", "basis")


@query("m14_parcel_signal_neighbours", f"""SELECT id, neighbor, round(distance * sqrt({len(V.PARCEL_FEATURES)}), 4)
    AS distance, rank FROM pn""", "distance", extra={"parcel_t": PARCEL, "pn": knn_sql("parcel_t", V.PARCEL_FEATURES, 3)})
def _(L):
    p = census.parcel_summary(L.view("parcels")).select("district_id", *V.PARCEL_FEATURES)
    near = sim.rank_shares(p, "district_id", V.PARCEL_FEATURES, 3)
    return near.select("id", "neighbor", F.round(F.col("distance") * len(V.PARCEL_FEATURES) ** 0.5, 4).alias("distance"),
                       "rank")


POOL = """SELECT g AS vec_id, list(m ORDER BY i) AS embedding FROM (SELECT vec_id // 10 AS g, i, avg(e[i]::DOUBLE)
      AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM main.embeddings) v, range(1, 65) r(i) GROUP BY 1, 2) q
    GROUP BY 1"""


@query("m15_pooled_neighbours", "SELECT * FROM cosn", "distance",
       extra={"pooled": POOL, "cosn": COS.format(k=3).replace("FROM embeddings", "FROM pooled")})
def _(L):
    v = vectors(L).withColumn("grp", F.expr("vec_id div 10"))
    return sim.nearest(sim.mean_pool(v, "grp", "vec"), 3, "grp", "vec", "cosine").drop("dims")


@query("m16_dequantised_vectors", """
    SELECT g AS grp, sum(s) / (sqrt(sum(s * s)) + 1e-9) AS total, max(s) / (sqrt(sum(s * s)) + 1e-9) AS top FROM (
      SELECT g, i, sum(pow(c / 127.5, 2) * sign(c)) AS s FROM (SELECT vec_id // 10 AS g, i,
        CASE WHEN vec_id % 7 = 0 AND i = 1 THEN -128 ELSE floor(e[i] * 100)::INT END AS c, vec_id
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v, range(1, 65) r(i)) q
      WHERE vec_id % 7 <> 0 GROUP BY 1, 2) z GROUP BY 1""", "total top")
def _(L):
    codes = F.transform("vec", lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 0), -128).otherwise(
        F.floor(x * 100).cast("int")))
    v = vectors(L).select(F.expr("vec_id div 10").alias("grp"), codes.alias("code"))
    s = sim.dequantised_sum(v, "grp", "code")
    return s.select("grp", F.aggregate("code", F.lit(0.0), lambda a, x: a + x).alias("total"),
                    F.array_max("code").alias("top"))


VLAB = ("SELECT vec_id, label AS p, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 END AS s FROM embeddings")


def vector_labels(L):
    return L.table("embeddings").select("vec_id", F.col("label").alias("primary"), F.when(
        F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).alias("secondary"))


@query("m17_hit_rates", """
    SELECT count(*) AS n, avg(h1) AS top1, avg(h3) AS top3, any_value(maj) AS majority FROM (
      SELECT c.id, max((hit AND rank = 1)::INT) AS h1, max(hit::INT) AS h3 FROM (SELECT c.id, c.rank,
        coalesce(b.p = a.p OR b.p = a.s, false) AS hit FROM cosn c JOIN vlab a ON a.vec_id = c.id
        JOIN vlab b ON b.vec_id = c.neighbor) c GROUP BY 1) q,
      (SELECT max(n) / sum(n) AS maj FROM (SELECT count(*) AS n FROM vlab GROUP BY p) z) m""", "top1 top3 majority",
       extra={"cosn": COS.format(k=3), "vlab": VLAB})
def _(L):
    near = sim.nearest(vectors(L), 3, "vec_id", "vec", "cosine")
    return sim.hit_rates(near, vector_labels(L), "vec_id")


@query("m17_lens_overlap", """
    SELECT id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jaccard FROM (
      SELECT id, list(neighbor) AS a FROM pk WHERE rank <= 3 GROUP BY 1) x JOIN (
      SELECT id, list(neighbor) AS b FROM sk WHERE rank <= 3 GROUP BY 1) y USING (id)""", "jaccard",
       extra={**PKNN, "st": STRUCT, "ssh": SSH, "sk": knn_sql("ssh", B, 3)})
def _(L):
    return sim.lens_overlap(sim.rank_shares(program_shares(L), "district_id", B, 3),
                            sim.rank_shares(structure_shares(L), "district_id", B, 3))


@query("m17_within_cross_gap", """
    SELECT avg(c) FILTER (WHERE same) AS same_label, avg(c) FILTER (WHERE NOT same) AS other_label,
      avg(c) FILTER (WHERE same) - avg(c) FILTER (WHERE NOT same) AS gap FROM (
      SELECT a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) q""", "same_label other_label gap")
def _(L):
    return sim.within_cross_gap(vectors(L), "vec_id", "vec", "label")


@query("m18_leave_one_out", """
    SELECT count(*) AS n, avg(h) AS hard, avg(y) AS hybrid FROM (SELECT p.id, max((p.rank = 1 AND
      coalesce(b.primary1 = a.primary1, false))::INT) AS h, max((coalesce(b.primary1 = a.primary1, false)
      OR coalesce(b.primary1 = a.secondary, false))::INT) AS y FROM pk p JOIN lab a ON a.district_id = p.id
      JOIN lab b ON b.district_id = p.neighbor WHERE a.primary1 IS NOT NULL GROUP BY 1) q""", "hard hybrid",
       extra={**PKNN, "lab": LAB})
def _(L):
    return sim.leave_one_out(sim.rank_shares(program_shares(L), "district_id", B, 7), labels(L),
                             "district_id")


def sep_sql(table: str) -> str:
    return (f"SELECT avg(({' + '.join(f'abs(g.{b} - o.{b})' for b in B)}) / 8) AS separation FROM (SELECT typology, "
            + ", ".join(f"avg({b}) AS {b}" for b in B) + f" FROM {table} JOIN districts USING (district_id) GROUP BY 1) g,"
            " (SELECT " + ", ".join(f"avg({b}) AS {b}" for b in B) + f" FROM {table}) o")


@query("m19_separation", f"SELECT a.separation AS program, b.separation AS structure FROM ({sep_sql('psh')}) a, "
       f"({sep_sql('ssh')}) b", "program structure", extra={"psh": PSH, "st": STRUCT, "ssh": SSH})
def _(L):
    t = L.view("districts").select("district_id", "typology")
    sep = lambda d, n: sim.separation(d.join(t, "district_id"), "typology", B).withColumnRenamed(
        "separation", n)
    return sep(program_shares(L), "program").crossJoin(F.broadcast(sep(structure_shares(L), "structure")))


@query("m20_channel_comparison", """
    SELECT district_id, p.residential AS program_share, s.residential AS structure_share,
      s.residential - p.residential AS delta, CASE WHEN s.residential - p.residential >= 0.05
      THEN 'structure finds housing' WHEN s.residential - p.residential <= -0.05 THEN 'program higher'
      ELSE 'agree' END AS flag FROM psh p JOIN ssh s USING (district_id)""",
       "program_share structure_share delta", extra={"psh": PSH, "st": STRUCT, "ssh": SSH})
def _(L):
    return sim.compare_channels(program_shares(L), structure_shares(L), "district_id")


def shape_rows(L):
    b = programs.add_shape_measures(L.buildings().select("district_id", "building_id", "rings"))
    return b.select("district_id", "building_id", "area_m2", F.log1p("area_m2").alias("la"), "compactness",
                    "solidity", "bbox_elongation")


@query("m21_form_families")
def _(L):
    cols = ["la", "compactness", "solidity", "bbox_elongation"]
    z = sim.robust_scale(shape_rows(L), cols)
    return clustering.form_families(z, ["district_id", "building_id"], cols)[0]


FORMS = {"form": """SELECT building_id, district_id, cluster_id, ln(1 + area_m2) AS la,
      4 * pi() * area_m2 / pow(perimeter_m, 2) AS compactness FROM buildings""",
         "middle": "SELECT cluster_id AS family, avg(la) AS la, avg(compactness) AS compactness FROM form GROUP BY 1"}


@query("m21_nearest_family", """
    SELECT building_id, arg_min(family, (round(pow(f.la - m.la, 2) + pow(f.compactness - m.compactness, 2), 9), family)) AS family
    FROM form f, middle m GROUP BY 1""", extra=FORMS)
def _(L):
    cols = ["la", "compactness"]
    rows = shape_rows(L).join(L.buildings().select("building_id", "cluster_id"), "building_id")
    middle = rows.groupBy(F.col("cluster_id").alias("family")).agg(*[F.avg(c).alias(c) for c in cols])
    return clustering.nearest_family(rows, middle, "building_id", cols)


def ward_rows(L):
    return clustering.prepare_tree(shape_rows(L), "building_id",
                                   ["la", "compactness", "solidity", "bbox_elongation"])


@query("m22_ward_clusters")
def _(L):
    rows = ward_rows(L)
    return clustering.cut_tree(rows, clustering.ward_merges(rows))


@query("m22_tree_shape")
def _(L):
    return clustering.tree_shape(clustering.ward_merges(ward_rows(L)))


@query("m22_tree_inertia", """
    SELECT district_id, count(*) - 1 AS merges, sum(z) AS inertia FROM (SELECT district_id, building_id,
      sum(pow(coalesce((v - m) / nullif(sd, 0), 0), 2)) AS z FROM (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd
        FROM tall WINDOW w AS (PARTITION BY district_id, f)) q GROUP BY ALL) r GROUP BY 1 HAVING count(*) > 1""",
       "inertia", extra={"tall": """
    SELECT district_id, building_id, f, v FROM (SELECT district_id, building_id, ln(1 + area_m2) AS la,
        4 * pi() * area_m2 / pow(perimeter_m, 2) AS compactness, area_m2 / ((greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3))
          * (greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3)) + 1e-9) AS solidity,
        greatest(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3), greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3))
          / (least(greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3), greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3)) + 1e-9)
          AS bbox_elongation FROM buildings JOIN buildings0 USING (building_id, district_id)) s
    UNPIVOT (v FOR f IN (la, compactness, solidity, bbox_elongation))"""})
def _(L):
    """Half the squared heights of a Ward tree add up to the squared distances of its leaves from their mean."""
    m = clustering.ward_merges(ward_rows(L))
    return m.groupBy("district_id").agg(F.count("*").alias("merges"), F.sum(F.col("height") ** 2 / 2).alias("inertia"))


@query("m22_leaf_order")
def _(L):
    from townloom.plans.aggregates import zoned_buildings

    e = programs.building_programs(zoned_buildings(L).drop("x", "y"), L.places())
    p = e.select("district_id", F.col("building_id").alias("id"), "dominant_program_inside")
    return clustering.leaf_order(clustering.ward_merges(ward_rows(L)), p)


@query("m23_light_clusters")
def _(L):
    return clustering.light_clusters(shape_rows(L), "building_id")


FORM = "SELECT district_id, " + ", ".join(
    f"count(*) FILTER (WHERE cluster_id = {i}) / count(*) AS f{i}" for i in range(1, 6)) + " FROM (SELECT district_id, CASE WHEN area_m2 < 300 THEN 1 WHEN area_m2 < 800 THEN 2 WHEN area_m2 < 1500 THEN 3 WHEN area_m2 < 4000 THEN 4 ELSE 5 END AS cluster_id FROM buildings) b GROUP BY 1"


@query("m24_form_fingerprint_neighbours", """
    SELECT id, neighbor, distance, CAST(r AS INTEGER) AS rank FROM (SELECT a.district_id AS id, b.district_id AS neighbor,
      round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance, row_number() OVER (PARTITION BY a.district_id
      ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 6), b.district_id) AS r
      FROM (SELECT district_id, [f1, f2, f3, f4, f5] AS v FROM form) a JOIN (SELECT district_id, [f1, f2, f3, f4, f5]
        AS v FROM form) b ON a.district_id <> b.district_id) q WHERE r <= 5""", "distance", extra={"form": FORM})
def _(L):
    fam = (F.when(F.col("area_m2") < 300, 1).when(F.col("area_m2") < 800, 2).when(
        F.col("area_m2") < 1500, 3).when(F.col("area_m2") < 4000, 4).otherwise(5))
    f = L.buildings().withColumn("fam", fam).groupBy("district_id").agg(F.array(*[
        F.count(F.when(F.col("fam") == i, 1)) / F.count("*") for i in range(1, 6)]).alias("vec"))
    return sim.nearest(f, 5, "district_id", "vec", "cosine").drop("dims")


@query("m25_program_coverage", """
    SELECT cluster_id, zone, count(*) AS n, avg((n_in > 0)::INT) AS coverage, avg(share) AS retail FROM bld_zone
    LEFT JOIN (SELECT building_id, count(*) AS n_in, count(*) FILTER (WHERE program = 'retail_food_entertainment')
      / count(*) AS share FROM place_bld WHERE inside GROUP BY 1) p USING (building_id)
    GROUP BY ALL""".replace("avg((n_in > 0)::INT)", "avg((coalesce(n_in, 0) > 0)::INT)"), "coverage retail")
def _(L):
    e = programs.building_programs(zoned_buildings(L).drop("x", "y"), L.places())
    r = F.coalesce(F.try_element_at("programs_inside", F.lit("retail_food_entertainment")), F.lit(0))
    return e.groupBy("cluster_id", "zone").agg(
        F.count("*").alias("n"), F.avg((F.col("place_count_inside") > 0).cast("int")).alias("coverage"),
        F.avg(F.when(F.col("place_count_inside") > 0, r / F.col("place_count_inside"))).alias("retail"))


@query("m26_comparison_record", """
    SELECT district_id, code, typology, n AS building_count, med AS median_area_m2, coalesce(na, 0) AS anchor_count,
      coalesce(ma, 0) AS max_anchor_area_m2 FROM districts JOIN (SELECT district_id, count(*) AS n,
        median(area_m2) AS med FROM buildings GROUP BY 1) b USING (district_id)
    LEFT JOIN (SELECT district_id, count(*) AS na, max(area_m2) AS ma FROM buildings WHERE area_m2 > 4000 GROUP BY 1) a
      USING (district_id)""", "median_area_m2 max_anchor_area_m2")
def _(L):
    from townloom.operators.features import comparison_record

    b = L.buildings().select("district_id", "area_m2")
    return comparison_record(L.view("districts"), b, b.where("area_m2 > 4000"))


@query("m28_order_from_pivot", """
    SELECT district_id, row_number() OVER (ORDER BY round(d, 9), district_id) AS place FROM (
      SELECT a.district_id, abs(a.pop - p.pop) AS d FROM feats a, (SELECT pop FROM feats WHERE district_id = 0) p) q""",
       extra={"feats": FSQL})
def _(L):
    from townloom.operators.ranks import ranked

    f = features(L)
    pivot = f.where("district_id = 0").select(F.col("pop").alias("_p"))
    d = f.crossJoin(F.broadcast(pivot)).withColumn("d", F.round(F.abs(F.col("pop") - F.col("_p")), 9))
    return ranked(d, "d", "district_id", best_is_high=False).select("district_id", F.col("rank").alias("place"))


@query("m29_comparison_board", """
    SELECT id, member, role, n_buildings, med, cov, top3 FROM (SELECT id, neighbor AS member, 'comparable' AS role FROM pk
      WHERE rank <= 2 UNION ALL SELECT DISTINCT id, id, 'site' FROM pk) m JOIN (SELECT b.district_id AS member,
        count(*) AS n_buildings, median(area_m2) AS med, avg((n IS NOT NULL)::INT) AS cov FROM buildings b
        LEFT JOIN (SELECT building_id, count(*) AS n FROM place_bld WHERE inside GROUP BY 1) p USING (building_id)
        GROUP BY 1) s USING (member)
    LEFT JOIN (SELECT district_id AS member, string_agg(program, ',' ORDER BY n DESC, program) AS top3 FROM (
        SELECT district_id, program, count(*) AS n, row_number() OVER (PARTITION BY district_id ORDER BY count(*) DESC,
          program) AS r FROM place_bld WHERE inside GROUP BY 1, 2) t WHERE r <= 3 GROUP BY 1) t USING (member)""",
       "med cov", extra=PKNN)
def _(L):
    from townloom.operators.features import comparison_board

    near = sim.rank_shares(program_shares(L), "district_id", B, 2)
    e = programs.building_programs(L.buildings(), L.places())
    return comparison_board(near, e)


@query("m30_site_facts", """
    SELECT district_id, metres, open_year FROM districts LEFT JOIN (SELECT s_suppkey // 2 AS district_id,
      max(s_acctbal) AS metres, max(1990 + s_suppkey % 30)::INT AS open_year FROM supplier
      GROUP BY 1) f USING (district_id)""", "metres")
def _(L):
    from townloom.operators.features import site_facts

    facts = L.table("supplier").groupBy(
        F.expr("s_suppkey div 2").alias("district_id")).agg(
        F.max("s_acctbal").alias("metres"), F.max(1990 + F.col("s_suppkey") % 30).cast("int")
        .alias("open_year"))
    return site_facts(L.view("districts"), facts)


REPORT = f"""SELECT d.district_id, n AS n_places, inside_n, c.difference AS retail_difference, top_program, near AS similar,
      {TOPT} AS top_type FROM districts d
    JOIN (SELECT district_id, count(*) AS n, count(*) FILTER (WHERE zone = 'interior') AS inside_n FROM place_zone
      GROUP BY 1) z USING (district_id)
    JOIN (SELECT district_id, interior_pct - exterior_pct AS difference FROM contrast
      WHERE program = 'retail_food_entertainment') c USING (district_id)
    JOIN (SELECT district_id, arg_min(program, (-n, program)) AS top_program FROM (SELECT district_id, program,
      count(*) AS n FROM places_p GROUP BY ALL) t GROUP BY 1) p USING (district_id)
    JOIN (SELECT id AS district_id, string_agg(CAST(neighbor AS VARCHAR), ',' ORDER BY rank) AS near FROM pk
      WHERE rank <= 5 GROUP BY 1) k USING (district_id)
    JOIN (SELECT id AS district_id, * FROM fit) f USING (district_id)"""


@query("district_report", REPORT, "retail_difference", extra={**FITX, "contrast": CONTRAST})
def _(L):
    from townloom.plans.report import district_report

    return district_report(L)
