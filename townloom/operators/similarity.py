"""Feature scaling, distances, neighbours and evaluation (M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.operators.neighbours import nearest, unit


def positioning(subjects: DataFrame, context: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """District value, context value and their ratio per metric."""
    long = lambda df, keys, name: df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name))
        for m in metrics])).alias("_m")).select(*keys, "_m.*")
    j = long(subjects, ["district_id", group], "value").join(
        long(context, [group], "context_value"), [group, "metric"], "left")
    ok = (F.col("value") != 0) & (F.col("context_value") != 0)
    return j.withColumn("ratio", F.when(ok, F.round(F.col("value") / F.col("context_value"), 3)))


def vector_of(values: list):
    """Feature expressions as one array; missing is NaN."""
    return F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in values])


# --- scaling ------------------------------------------------------------------------------------


def _one_row(df: DataFrame, aggs: list) -> DataFrame:
    """Statistics of the whole frame attached to each row (a single broadcast row)."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def zscore_sample(df: DataFrame, columns: list[str]) -> DataFrame:
    """M2: sample standard deviation; constant columns and missing values become 0."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"_m{c}"), F.stddev_samp(c).alias(f"_s{c}"))]
    z = lambda c: F.coalesce(F.when(F.col(f"_s{c}") > 1e-10, (F.col(c) - F.col(f"_m{c}"))
                                    / F.col(f"_s{c}")), F.lit(0.0))
    keep = [c for c in df.columns if c not in columns]
    return _one_row(df, aggs).select(*keep, *[z(c).alias(c) for c in columns])


def complete_columns(df: DataFrame, optional: list[str], columns: list[str]) -> list[str]:
    """M2: the columns to use; the optional ones only when no district lacks any of them."""
    gaps = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in optional]).first()
    return columns if any(gaps[c] for c in optional) else columns + optional


def zscore_population(df: DataFrame, columns: list[str], digits: int = 4, fill: bool = True
                      ) -> DataFrame:
    """M3: population standard deviation over the districts that have the value (at least two)."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"_m{c}"), F.stddev_pop(c).alias(f"_s{c}"),
                                         F.count(c).alias(f"_n{c}"))]

    def z(c):
        sd = F.when(F.col(f"_s{c}") > 1e-12, F.col(f"_s{c}")).otherwise(1.0)
        v = F.when(F.col(f"_n{c}") >= 2, F.round((F.col(c) - F.col(f"_m{c}")) / sd, digits))
        return F.coalesce(v, F.lit(0.0)) if fill else v

    keep = [c for c in df.columns if c not in columns]
    return _one_row(df, aggs).select(*keep, *[z(c).alias(c) for c in columns])


def robust_scale(df: DataFrame, columns: list[str], clip: float = 8.0) -> DataFrame:
    """M4: median and interquartile range over all rows, tiny ranges count as 1, clipped; one pass for all columns."""
    from townloom.operators.ranks import quantiles_of

    q = quantiles_of(df, [], columns, {"_l": 0.25, "_m": 0.5, "_h": 0.75})

    def scaled(c):
        spread = F.col(f"_h_{c}") - F.col(f"_l_{c}")
        v = (F.col(c) - F.col(f"_m_{c}")) / F.when(spread < 1e-6, 1.0).otherwise(spread)
        return F.least(F.greatest(v, F.lit(-clip)), F.lit(clip)).alias(c)

    return df.crossJoin(F.broadcast(q)).select(*[scaled(c) if c in columns else F.col(c) for c in df.columns])


def long_features(df: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    return df.select(ident, F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    ).alias("_f")).select(ident, "_f.feature", "_f.value")


def distances_to(df: DataFrame, focus: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """Cosine distance of every row to the focus rows; a missing feature counts as 0.

    Rows are dealt to parts, a few for each core, and every part meets all focus rows, one pair at a time: a pair is
    a row of the result, so pairs are neither grouped nor sent on.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    value = lambda c: F.col(c).cast("double")
    rows = df.select(ident, *(value(c).alias(f"_v{i}") for i, c in enumerate(columns)),
                     F.pmod(F.xxhash64(ident), F.lit(parts)).cast("int").alias("_p"))
    held = focus.select(F.col(ident).alias("focus"), *(value(c).alias(f"_f{i}") for i, c in enumerate(columns)),
                        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    # the count is explicit: by their size, rows that make so many pairs would be put into one task
    rows, held = rows.repartition(parts, "_p"), held.repartition(parts, "_p")
    total = lambda a, b: sum((F.coalesce(F.col(f"{a}{i}") * F.col(f"{b}{i}"), F.lit(0.0))
                              for i in range(len(columns))), F.lit(0.0))
    return rows.join(held, "_p").select("focus", ident, (1 - F.coalesce(F.try_divide(
        total("_v", "_f"), F.sqrt(total("_v", "_v") * total("_f", "_f"))), F.lit(0.0))).alias("distance"))


def principal_components(df: DataFrame, ident: list[str], columns: list[str], n: int = 2):
    """M6 / M7: projection on the first components and their variance shares.

    MLlib does not centre, so pass z-scored columns. The sign makes each component's largest
    loading positive. Returns (projection, shares, loadings).
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    asm = VectorAssembler(inputCols=columns, outputCol="_v").transform(df)
    model = PCA(k=n, inputCol="_v", outputCol="_p").fit(asm)
    load = model.pc.toArray()
    flip = np.sign(load[np.abs(load).argmax(axis=0), np.arange(n)])
    load = load * flip
    coord = [sum([F.col(c) * float(load[i, j]) for i, c in enumerate(columns)], F.lit(0.0))
             .alias(f"PC{j + 1}") for j in range(n)]
    return df.select(*ident, *coord), [float(x) for x in model.explainedVariance], load


def panel_components(panel: DataFrame, ident: list[str], columns: list[str], n: int = 2):
    """M7: one fixed basis over all (district, year) rows; incomplete rows are left out."""
    whole = panel.dropna(subset=columns)
    spread = whole.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    flat = [c for c in columns if not spread[c]]
    if flat:
        raise ValueError(f"columns without variance: {flat}")
    return principal_components(zscore_population(whole, columns, digits=12), ident, columns, n)


def distinguishing(pairs: DataFrame, df: DataFrame, ident: str, columns: list[str], k: int = 8
                   ) -> DataFrame:
    """M8: the features that differ most for each listed pair."""
    f = long_features(df, ident, columns)
    a = f.select(F.col(ident).alias("a"), "feature", F.col("value").alias("a_z"))
    b = f.select(F.col(ident).alias("b"), "feature", F.col("value").alias("b_z"))
    d = pairs.select("a", "b").join(a, "a").join(b, ["b", "feature"]).withColumn(
        "abs_diff", F.round(F.abs(F.col("a_z") - F.col("b_z")), 9))
    w = Window.partitionBy("a", "b").orderBy(F.desc("abs_diff"), "feature")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_demographics(queries: DataFrame, corpus: DataFrame, ident: str, columns: list[str],
                      log_columns=(), k: int = 8) -> DataFrame:
    """M9: nearest corpus districts by RMS z-distance over the features both sides have.

    A feature counts only if half of the corpus has it, and three of its districts at least. Queries are other
    districts than those of the corpus, whatever their ids.
    """
    scaled = lambda d: d.select(ident, *[(F.log1p(c) if c in log_columns else F.col(c)).cast(
        "double").alias(c) for c in columns])
    c0, q0 = scaled(corpus), scaled(queries)
    often = lambda c: F.count(c) >= F.greatest(F.lit(3), F.floor(F.count("*") / 2))
    stats = c0.agg(*[a for c in columns for a in (F.when(often(c), F.avg(c)).alias(f"_m{c}"), F.stddev_pop(c)
                                                  .alias(f"_s{c}"))])

    def z(d):
        sd = lambda c: F.when(F.col(f"_s{c}") > 0, F.col(f"_s{c}")).otherwise(1.0)
        return d.crossJoin(F.broadcast(stats)).select(ident, vector_of(
            [(F.col(c) - F.col(f"_m{c}")) / sd(c) for c in columns]).alias("vec"))

    return nearest(z(q0), k, ident, "vec", corpus=z(c0), shared=True, skip_own=False)


def rank_shares(shares: DataFrame, ident: str, columns: list[str], k: int, among: DataFrame | None = None) -> DataFrame:
    """Nearest districts by RMS z-distance of bucket shares, of those listed in `among` if given."""
    z = zscore_population(shares, columns, digits=12)
    root = float(np.sqrt(len(columns)))
    v = z.select(ident, F.array(*[F.col(c) / root for c in columns]).alias("vec"))
    corpus = v.join(among.select(ident), ident, "left_semi") if among is not None else None
    return nearest(v, k, ident, "vec", corpus=corpus)


def typology_fit(neighbours: DataFrame, labels: DataFrame, ident: str, types: list[str],
                 eps: float = 1e-3) -> DataFrame:
    """Percentage fit to each type from the neighbours' votes.

    A neighbour votes its primary type with 1/(distance + eps) and its secondary with half.
    """
    lab = labels.select(F.col(ident).alias("neighbor"), F.coalesce("primary", "fallback").alias(
        "_p"), F.col("secondary").alias("_s"))
    w = 1.0 / (F.col("distance") + eps)
    v = neighbours.join(lab, "neighbor")
    vote = lambda t: F.sum(F.when(F.col("_p") == t, w).otherwise(0.0)
                           + F.when(F.col("_s") == t, w * 0.5).otherwise(0.0))
    g = v.groupBy("id").agg(*[vote(t).alias(f"_w{i}") for i, t in enumerate(types)])
    total = sum([F.col(f"_w{i}") for i in range(1, len(types))], F.col("_w0"))
    pct = lambda i: F.round(100.0 * F.col(f"_w{i}") / F.when(total > 0, total).otherwise(1.0), 1)
    best = F.array_min(F.array(*[F.struct((-pct(i)).alias("p"), F.lit(i).alias("i"), F.lit(t)
                                          .alias("t")) for i, t in enumerate(types)]))
    return g.select("id", *[pct(i).alias("pct_" + t.lower().replace(" ", "_"))
                            for i, t in enumerate(types)], best["t"].alias("top_type"))


def fit_reason(shares: DataFrame, fit: DataFrame, ident: str) -> DataFrame:
    """The leading type's driving buckets above 2 %, largest first, as text."""
    drivers = F.create_map(*[x for t, bs in V.TYPOLOGY_DRIVERS.items() for x in (
        F.lit(t), F.array(*[F.lit(b) for b in bs]))])
    pairs = F.array(*[F.struct((-F.round(F.col(b), 3)).alias("v"), F.lit(b).alias("b"))
                      for b in V.BUCKETS])
    j = fit.join(shares, fit["id"] == shares[ident])
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] < -0.02) & F.array_contains(
        F.try_element_at(drivers, F.col("top_type")), p["b"])))
    text = F.array_join(F.transform(kept, lambda p: F.concat(
        F.replace(p["b"], F.lit("_"), F.lit(" ")), F.lit(" "), F.round(-p["v"] * 100).cast("int")
        .cast("string"), F.lit("%"))), ", ")
    return j.select("id", F.coalesce(F.nullif(text, F.lit("")), F.lit(
        "mixed program with no single dominant use")).alias("why"))


def suggest_type(neighbours: DataFrame, confirmed: DataFrame, ident: str, k: int = 6) -> DataFrame:
    """Most supported type among the k nearest confirmed districts, with its confidence."""
    lab = confirmed.select(F.col(ident).alias("neighbor"), F.col("label").alias("_l"))
    w = Window.partitionBy("id").orderBy("distance", "neighbor")
    top = neighbours.join(lab, "neighbor").withColumn("_r", F.row_number().over(w)).where(
        F.col("_r") <= k)
    vote = top.groupBy("id", "_l").agg(F.sum(1.0 / (F.col("distance") + 0.05)).alias("_v"))
    g = vote.groupBy("id").agg(F.min_by("_l", F.struct(-F.round("_v", 9), "_l")).alias("label"),
                               F.max("_v").alias("_m"), F.sum("_v").alias("_t"))
    return g.select("id", "label", (F.col("_m") / F.col("_t")).alias("confidence"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Neighbours of the first table; districts it does not know take the second."""
    return first.withColumn("basis", F.lit("distance")).unionByName(
        second.join(first.select("id").distinct(), "id", "left_anti").withColumn(
            "basis", F.lit("shares")))


def mean_pool(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """Element-wise mean of the vectors of each group."""
    long = rows.select(group, F.posexplode(vec).alias("_i", "_v"))
    m = long.groupBy(group, "_i").agg(F.avg("_v").alias("_m"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))),
                                            lambda s: s["_m"]).alias(vec))


def dequantised_sum(pixels: DataFrame, group: str, vec: str) -> DataFrame:
    """Codes to numbers, summed per band and scaled to unit length; nodata pixels drop out."""
    div = V.VECTOR_DEQUANT_DIVISOR
    ok = pixels.where(~F.exists(vec, lambda x: x == V.VECTOR_NODATA))
    long = ok.select(group, F.posexplode(vec).alias("_i", "_c"))
    v = (F.col("_c") / div) * (F.col("_c") / div) * F.signum(F.col("_c").cast("double"))
    s = long.groupBy(group, "_i").agg(F.sum(v).alias("_s"))
    g = s.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))),
                                         lambda t: t["_s"]).alias("_v"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)) + F.lit(1e-9)
    return g.withColumn("_n", norm).select(group, F.transform(
        "_v", lambda x: x / F.col("_n")).alias(vec))


def hit_rates(neighbours: DataFrame, labels: DataFrame, ident: str) -> DataFrame:
    """Share of rows with a neighbour of their primary or secondary label in the top 1 / 3."""
    lab = labels.where("primary is not null").select(ident, "primary", "secondary")
    mine = lab.select(F.col(ident).alias("id"), "primary", "secondary")
    theirs = lab.select(F.col(ident).alias("neighbor"), F.col("primary").alias("_np"))
    j = mine.join(neighbours.where("rank <= 3"), "id", "left").join(theirs, "neighbor", "left")
    hit = (F.col("_np") == F.col("primary")) | (F.col("_np") == F.col("secondary"))
    flag = lambda top: F.max(F.when(F.coalesce(hit, F.lit(False)) & (F.col("rank") <= top), 1)
                             .otherwise(0))
    per = j.groupBy("id").agg(flag(1).alias("_1"), flag(3).alias("_3"))
    top = lab.groupBy("primary").agg(F.count("*").alias("_n")).agg(
        (F.max("_n") / F.sum("_n")).alias("majority"))
    return per.agg(F.count("*").alias("n"), F.avg("_1").alias("top1"), F.avg("_3").alias("top3")
                   ).crossJoin(F.broadcast(top))


def lens_overlap(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """Jaccard overlap of the top-k neighbours of two lenses."""
    top = lambda d, n: d.where(F.col("rank") <= k).groupBy("id").agg(
        F.collect_set("neighbor").alias(n))
    j = top(a, "x").join(top(b, "y"), "id")
    return j.select("id", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")))
                    .alias("jaccard"))


def within_cross_gap(rows: DataFrame, ident: str, vec: str, label: str) -> DataFrame:
    """Mean cosine of pairs with the same label and of other pairs, and their gap.

    For unit vectors the sum over all pairs follows from the vector sums, so no pair is formed.
    """
    u = rows.where(F.col(label).isNotNull()).select(label, F.posexplode(unit(vec)).alias("_i", "_v"))
    per = u.groupBy(label, "_i").agg(F.sum("_v").alias("_s"), F.sum(F.col("_v") ** 2).alias("_q"),
                                     F.count("*").alias("_n"))
    grp = per.groupBy(label).agg(F.sum(F.col("_s") ** 2).alias("_g"), F.sum("_q").alias("_q"),
                                 F.max("_n").cast("double").alias("_n"))
    same = grp.agg(F.sum(F.col("_g") - F.col("_q")).alias("_sw"),
                   F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_pw"),
                   F.sum("_q").alias("_q"), F.sum("_n").alias("_n"))
    alls = per.groupBy("_i").agg(F.sum("_s").alias("_s")).agg(F.sum(F.col("_s") ** 2).alias("_t"))
    j = same.crossJoin(F.broadcast(alls))
    within = F.col("_sw") / F.col("_pw")
    cross = (F.col("_t") - F.col("_q") - F.col("_sw")) / (
        F.col("_n") * (F.col("_n") - 1) - F.col("_pw"))
    return j.select(within.alias("same_label"), cross.alias("other_label"), (within - cross).alias("gap"))


def leave_one_out(neighbours: DataFrame, labels: DataFrame, ident: str, k: int = 7) -> DataFrame:
    """Share of labelled rows placed right by the nearest one (hard) or by any of k (hybrid).

    Scaling is done once with the held-out row included; neighbours without a label count.
    """
    mine = labels.where("primary is not null").select(F.col(ident).alias("id"), "primary", "secondary")
    theirs = labels.select(F.col(ident).alias("neighbor"), F.col("primary").alias("_np"))
    j = neighbours.where(F.col("rank") <= k).join(mine, "id").join(theirs, "neighbor")
    same = F.coalesce(F.col("_np") == F.col("primary"), F.lit(False))
    known = same | F.coalesce(F.col("_np") == F.col("secondary"), F.lit(False))
    per = j.groupBy("id").agg(F.max(F.when((F.col("rank") == 1) & same, 1).otherwise(0)).alias("_h"),
                              F.max(F.when(known, 1).otherwise(0)).alias("_y"))
    return per.agg(F.count("*").alias("n"), F.avg("_h").alias("hard"), F.avg("_y").alias("hybrid"))


def separation(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Mean over groups of the mean absolute difference to the row-weighted overall mean."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
    overall = df.agg(*[F.avg(c).alias(f"_o{c}") for c in columns])
    diff = sum([F.abs(F.col(c) - F.col(f"_o{c}")) for c in columns[1:]],
               F.abs(F.col(columns[0]) - F.col(f"_o{columns[0]}"))) / len(columns)
    return g.crossJoin(F.broadcast(overall)).agg(
        F.when(F.count("*") >= 2, F.avg(diff)).alias("separation"))


def compare_channels(program: DataFrame, structure: DataFrame, ident: str) -> DataFrame:
    """Residential share of two channels and which one finds more housing (5 points)."""
    j = program.select(ident, F.col("residential").alias("program_share")).join(
        structure.select(ident, F.col("residential").alias("structure_share")), ident)
    d = F.col("structure_share") - F.col("program_share")
    return j.withColumn("delta", d).withColumn("flag", F.when(
        d >= 0.05, "structure finds housing").when(d <= -0.05, "program higher").otherwise("agree"))
