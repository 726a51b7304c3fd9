"""Form families and hierarchical clusters of footprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.operators.ranks import quantiles, quantiles_of
from townloom.operators.spatial import KEYS
from townloom.session import cut_round as cut

BLOCK_ROWS = 1024
MAX_ROUNDS = 100_000


def form_families(df: DataFrame, ident: list[str], columns: list[str], ks=range(4, 11), seed: int = 0):
    """K-means over all footprints, k by the silhouette of all rows.

    Returns (labelled rows, k, silhouette by k). Features are computed once and checkpointed; the
    silhouette needs only sums per family.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = cut(VectorAssembler(inputCols=columns, outputCol="features").transform(df).select(
        *ident, "features"))
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="family")
    scores, models = {}, {}
    for k in ks:
        models[k] = KMeans(k=k, seed=seed, predictionCol="family").fit(x)
        scores[k] = float(judge.evaluate(models[k].transform(x)))
    k = max(scores, key=lambda v: (scores[v], -v))
    return models[k].transform(x).drop("features"), k, scores


def nearest_family(df: DataFrame, centres: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """The family with the closest centre; centres are a handful of rows."""
    c = F.broadcast(centres.select("family", *[F.col(n).alias(f"_c{n}") for n in columns]))
    d2 = sum([(F.col(n) - F.col(f"_c{n}")) ** 2 for n in columns[1:]],
             (F.col(columns[0]) - F.col(f"_c{columns[0]}")) ** 2)
    return df.crossJoin(c).groupBy(ident).agg(F.min_by("family", F.struct(
        F.round(d2, 9), "family")).alias("family"))


def light_clusters(df: DataFrame, ident: str, keys=KEYS, rounds: int = 1000) -> DataFrame:
    """K-means on scaled (log area, compactness) in all districts at once.

    k = n/20 clamped to 2..4, none below eight footprints. Centres start at area quantiles, so
    the result is repeatable; each round is one join and one aggregation.
    """
    k = list(keys)
    base = df.select(*k, ident, F.log1p("area_m2").alias("a"), F.col("compactness").alias("b"))
    st = base.groupBy(*k).agg(F.count("*").alias("n"), *[f(c).alias(f"{t}{c}") for c in "ab" for t, f in (
        ("m", F.avg), ("s", F.stddev_pop))])
    z = base.join(st, k).select(
        *k, ident, "n", *[((F.col(c) - F.col(f"m{c}")) / (F.col(f"s{c}") + F.lit(1e-9))).alias(c)
                          for c in "ab"])
    z = cut(z.withColumn("k", F.least(F.lit(4), F.greatest(F.lit(2), F.floor(F.col("n") / 20)))))
    big = z.where("n >= 8")
    q = quantiles(big, k, "a", {f"q{i}": (i + 0.5) / 4 for i in range(4)})
    kk = big.select(*k, "k").distinct()
    # the starting areas are the middles of k equal parts, taken from the four quantiles
    pos = lambda i: F.when(F.col("k") == 2, F.col(f"q{[0, 3, 3, 3][i]}")).when(
        F.col("k") == 3, F.col(f"q{[0, 1, 3, 3][i]}")).otherwise(F.col(f"q{i}"))
    centres = q.join(kk, k).select(*k, F.explode(F.slice(F.array(*[F.struct(
        F.lit(i).alias("c"), pos(i).alias("ca"), F.lit(0.0).alias("cb")) for i in range(4)]), 1, F.col("k").cast("int"))
    ).alias("_c")).select(*k, "_c.*")
    centres = cut(centres)
    for _ in range(rounds):
        d2 = (F.col("a") - F.col("ca")) ** 2 + (F.col("b") - F.col("cb")) ** 2
        near = big.join(centres, k).groupBy(*k, ident, "a", "b").agg(
            F.min_by("c", F.struct(F.round(d2, 9), "c")).alias("c"))
        moved = cut(near.groupBy(*k, "c").agg(F.avg("a").alias("ca"), F.avg("b").alias("cb")))
        step = moved.join(centres.withColumnRenamed("ca", "oa").withColumnRenamed("cb", "ob"), [*k, "c"])
        still = step.where((F.abs(F.col("ca") - F.col("oa")) > 1e-9)
                           | (F.abs(F.col("cb") - F.col("ob")) > 1e-9)).isEmpty()
        centres = moved
        if still:
            break
    else:
        raise RuntimeError(f"centres have not settled after {rounds} rounds")
    d2 = (F.col("a") - F.col("ca")) ** 2 + (F.col("b") - F.col("cb")) ** 2
    out = big.join(centres, k).groupBy(*k, ident).agg(
        F.min_by("c", F.struct(F.round(d2, 9), "c")).alias("cluster_id"))
    return out.unionByName(z.where("n < 8").select(*k, ident, F.lit(0).alias("cluster_id")))


def prepare_tree(df: DataFrame, ident: str, columns: list[str], keys=KEYS) -> DataFrame:
    """Rows with at most a quarter of features missing, medians filled in, z-scored."""
    k = list(keys)
    missing = sum([F.col(c).isNull().cast("int") for c in columns[1:]],
                  F.col(columns[0]).isNull().cast("int"))
    d = cut(df.where(missing <= len(columns) // 4).select(*k, ident, *columns))
    q = quantiles_of(d, k, columns, {"_m": 0.5})
    d = cut(d.join(q, k, "left").select(*k, ident, *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in columns]))
    st = d.groupBy(*k).agg(*[a for c in columns for a in (F.avg(c).alias(f"_a{c}"), F.stddev_pop(c)
                                                          .alias(f"_s{c}"))])
    z = lambda c: (F.col(c) - F.col(f"_a{c}")) / F.when(F.col(f"_s{c}") > 0, F.col(f"_s{c}")
                                                        ).otherwise(1.0)
    return d.join(st, k).select(*k, F.col(ident).alias("id"),
                                F.array(*[z(c) for c in columns]).alias("vec"))


def ward_merges(rows: DataFrame, keys=KEYS, block: int = BLOCK_ROWS) -> DataFrame:
    """The merges of the Ward tree of each district: a, b, height, size.

    A cluster is named by its smallest member. A round merges all pairs of clusters that are each other's nearest,
    in all districts at once. Merging never brings a cluster nearer to a third one than its parts were, so
    only new clusters, and those whose nearest was merged, look again; they meet the district's clusters as
    packed blocks in Arrow calls. Heights are rounded to nine digits, ties take the smaller name.
    """
    k = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ident = kinds["id"]
    open_ = lambda d: d.withColumns({"nn": F.lit(None).cast(ident), "h": F.lit(None).cast("double")})
    state = cut(open_(rows.select(*k, "id", "vec", F.lit(1).cast("long").alias("size"))))
    schema = ", ".join(f"{c} {kinds[c]}" for c in k) + f", id {ident}, nn {ident}, h double"
    out = None
    for _ in range(MAX_ROUNDS):
        near = _nearest_clusters(state, k, schema, block)
        found = cut(state.drop("nn", "h").join(state.where("nn IS NOT NULL").select(*k, "id", "nn", "h").unionByName(near),
                                               [*k, "id"], "left"))
        side = lambda end, other: found.select(*k, F.col("id").alias(end), F.col("nn").alias(other), F.col("vec").alias("v" + end),
                                               F.col("size").alias("n" + end), F.col("h").alias("h" + end))
        m = cut(side("a", "b").where("a < b").join(side("b", "a"), [*k, "a", "b"]))
        if m.isEmpty():
            if found.where("nn IS NOT NULL").isEmpty():
                if out is None:
                    out = m.select(*k, "a", "b", F.lit(0.0).alias("height"), F.lit(1).cast("long").alias("size"))
                return out
            state = cut(open_(found.drop("nn", "h")))  # names of equally near clusters went in a circle: all look again
            continue
        both = F.col("na") + F.col("nb")
        step = m.select(*k, "a", "b", F.sqrt(F.least("ha", "hb")).alias("height"), both.alias("size"))
        out = step if out is None else out.unionByName(step)
        fused = m.select(*k, F.col("a").alias("id"), F.zip_with("va", "vb", lambda p, q: (
            p * F.col("na") + q * F.col("nb")) / both).alias("vec"), both.alias("size"))
        used = m.select(*k, F.explode(F.array("a", "b")).alias("id"))
        left = found.join(used, [*k, "id"], "left_anti")
        lost = used.select(*k, F.col("id").alias("nn"), F.lit(True).alias("_lost"))
        kept = left.join(lost, [*k, "nn"], "left").select(
            *k, "id", "vec", "size", F.when(F.col("_lost").isNull(), F.col("nn")).alias("nn"),
            F.when(F.col("_lost").isNull(), F.col("h")).alias("h"))
        state = cut(kept.unionByName(open_(fused)))
    raise RuntimeError("the tree did not close")


def _nearest_clusters(state: DataFrame, k: list[str], schema: str, block: int) -> DataFrame:
    """(id, nn, h) of the clusters without a known nearest: squared heights, by blocks of one district."""
    n = state.groupBy(*k).agg(F.ceil(F.count("*") / block).cast("int").alias("_p"), F.count("*").alias("_n")).where("_n > 1")
    d = state.join(n.drop("_n"), k).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("_p")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("id", "size", "vec")))
    asked = d.where("nn IS NULL").groupBy(*k, "sub", "_p").agg(rows.alias("q"))
    asked = asked.select(*k, "q", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("sub"))
    pairs = asked.join(d.groupBy(*k, "sub").agg(rows.alias("c")), [*k, "sub"])

    def solve(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                part = lambda name, side: np.array([r[name] for r in side])
                qi, ci = part("id", row.q), part("id", row.c)
                qs, cs = part("size", row.q).astype(float)[:, None], part("size", row.c).astype(float)[None, :]
                a, b = part("vec", row.q).astype(float), part("vec", row.c).astype(float)
                h = np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T, 0)
                h = np.round(h * 2 * qs * cs / (qs + cs), 9)
                h[qi[:, None] == ci[None, :]] = np.inf
                best = h.argmin(1)  # rows are sorted, so ties take the smaller name
                low = h[np.arange(len(qi)), best]
                ok = np.isfinite(low)
                yield pd.DataFrame({**{c: [getattr(row, c)] * int(ok.sum()) for c in k}, "id": qi[ok], "nn": ci[best][ok], "h": low[ok]})

    near = pairs.mapInPandas(solve, schema)
    return near.groupBy(*k, "id").agg(F.min_by(F.struct("nn", "h"), F.struct("h", "nn")).alias("_b")).select(
        *k, "id", "_b.nn", "_b.h")


def cut_tree(rows: DataFrame, merges: DataFrame, clusters: int = 8, keys=KEYS) -> DataFrame:
    """The tree cut into min(clusters, n - 1) groups: merges above the cut are undone."""
    from townloom.operators.graph import connected_components

    k = list(keys)
    n = rows.groupBy(*k).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*k).orderBy(F.desc("height"), "a", "b")
    top = merges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") < clusters)
    top = cut(top.join(n, k).where(F.col("_r") < F.least(F.lit(clusters), F.col("_n") - 1)))
    keep = merges.join(top.select(*k, "a", "b"), [*k, "a", "b"], "left_anti")
    parts = connected_components(rows.select(*k, F.col("id").alias("node")), keep.select(
        *k, F.col("a").alias("src"), F.col("b").alias("dst")), keys)
    size = parts.groupBy(*k, "component").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*k).orderBy("component")
    return parts.join(size.withColumn("cluster_id", F.row_number().over(order)), [*k, "component"]
                      ).select(*k, F.col("node").alias("id"), "cluster_id", "size")


def tree_shape(merges: DataFrame, keys=KEYS) -> DataFrame:
    """Largest merge height, median, p90 and skewness of the heights."""
    k = list(keys)
    q = quantiles(merges, k, "height", {"height_p50": 0.5, "height_p90": 0.9})
    return merges.groupBy(*k).agg(F.max("height").alias("max_height"),
                                  F.skewness("height").alias("height_skew")).join(q, k)


def leaf_order(merges: DataFrame, programs: DataFrame, keys=KEYS) -> DataFrame:
    """Position of every leaf from left to right (from 0) with its program.

    Of the two children of a merge the left one is a leaf before a cluster, then the one that formed at the smaller
    height, then the smaller name. A leaf's position sums the sizes of the left siblings of the right
    children on its way to the root; ways are added up by pointer jumping, so the rounds grow with the
    logarithm of the tree's depth.
    """
    k = list(keys)
    named = Window.partitionBy(*k, "a").orderBy("size")
    m = merges.select(*k, "a", "b", "height", "size", F.coalesce(F.lag("size").over(named), F.lit(1)).alias("na"),
                      F.lag("height").over(named).alias("ha"))
    own = merges.groupBy(*k, F.col("a").alias("b")).agg(F.max_by("height", "size").alias("hb"))
    m = m.join(own, [*k, "b"], "left").withColumn("nb", F.col("size") - F.col("na"))
    # the name a also formed the parent and larger clusters; b stood for its last one, of this size
    m = m.withColumn("hb", F.when(F.col("nb") > 1, F.col("hb")))
    place = lambda h, name: F.struct(F.coalesce(h, F.lit(-1.0)).alias("h"), F.col(name).alias("name"))
    a_left = place(F.col("ha"), "a") < place(F.col("hb"), "b")
    node = lambda name, size: F.struct(F.col(name).alias("name"), F.col(size).cast("long").alias("size"))
    up = node("a", "size").alias("parent")
    ways = m.select(*k, node("a", "na").alias("node"), up, F.when(a_left, 0).otherwise(F.col("nb")).cast("long").alias("shift")).unionByName(
        m.select(*k, node("b", "nb").alias("node"), up, F.when(a_left, F.col("na")).otherwise(0).cast("long").alias("shift")))
    ways = cut(ways)
    for _ in range(64):  # doubles the steps taken
        if ways.where("parent IS NOT NULL").isEmpty():
            break
        above = ways.select(*k, F.col("node").alias("parent"), F.col("parent").alias("_next"), F.col("shift").alias("_more"))
        ways = cut(ways.join(above, [*k, "parent"], "left").select(
            *k, "node", F.col("_next").alias("parent"), (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift")))
    leaves = ways.where("node.size = 1").select(*k, F.col("node.name").alias("id"), F.col("shift").alias("position"))
    return leaves.join(programs, [*k, "id"], "left")
