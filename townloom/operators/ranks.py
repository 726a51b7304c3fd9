"""Ranks, percentiles and quantiles that stay distributed.

The base is the rank table of distinct values: one row per (keys, value) with the number of
rows at, below and in total. Rows are counted per value before any shuffle of the group. A group is cut
into ranges at sampled splitters, about SPLIT_VALUES distinct values apart whatever their distribution;
the offsets of ranges come from exact counts. One plan serves all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townloom.session import worked_out

SPLIT_VALUES = 65_536


def value_ranks(df: DataFrame, keys: list[str], value: str, split: int | None = None,
                weight: str | None = None) -> DataFrame:
    """Distinct values with n (rows equal), le (rows at or below) and total (rows of the group);
    with a weight column, sums of weights instead of rows. `split` overrides SPLIT_VALUES."""
    return _ranked(df, keys, value, split, weight).where("v IS NOT NULL")


def _ranked(df: DataFrame, keys: list[str], value: str, split: int | None, weight: str | None = None) -> DataFrame:
    """value_ranks, and for groups with rows without a value one row with a null v and n = 0."""
    number = F.col(value).cast("double")
    v = F.when(~F.isnan(number), number)
    size = F.col(weight) if weight else F.lit(1)
    # splitters are chosen by a filter on the values, which must not work them out anew below their sources
    values = worked_out(df.select(*keys, v.alias("v"), size.alias("n")))
    vc = values.groupBy(*keys, "v").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n"))
    chosen = vc.where(F.pmod(F.xxhash64("v"), F.lit(split or SPLIT_VALUES)) == 0)
    cuts = F.array_sort(F.collect_list("v")).alias("_cuts")
    parted = vc.join(chosen.groupBy(*keys).agg(cuts), keys, "left") if keys else _join(vc, chosen.agg(cuts), keys)
    parted = parted.select(*keys, "v", "n", _splitters_up_to("_cuts", "v").alias("_part"))
    every = Window.partitionBy(*keys)
    sums = parted.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    sums = (sums.withColumn("_before", F.sum("_n").over(every.orderBy("_part")) - F.col("_n"))
            .withColumn("total", F.sum("_n").over(every)).drop("_n"))
    local = Window.partitionBy(*keys, "_part").orderBy("v")
    out = parted.withColumn("_le", F.sum("n").over(local)).join(sums, [*keys, "_part"])
    return out.select(*keys, "v", "n", (F.col("_le") + F.col("_before")).alias("le"), "total")


def _splitters_up_to(cuts: str, v: str) -> Column:
    """How many of the ascending splitters are at or below the value, by halving."""
    size = F.coalesce(F.size(cuts), F.lit(0))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))

    def halved(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(F.col(cuts), mid) <= F.col(v))
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halved)
    return F.when((size == 0) | F.col(v).isNull(), 0).otherwise(found["lo"])


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys, or attach a single row when there are none."""
    if keys:
        return left.join(right, keys)
    return left.crossJoin(F.broadcast(right))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              how: str = "linear", split: int | None = None) -> DataFrame:
    """Exact quantiles per group; null for a group without values.

    linear: interpolated at p·(n-1). index: the value at floor(p·n), capped at the last one
    (class breaks; with p = 0.5 the upper middle of W7 and A13).
    """
    ranks = _ranked(df, keys, value, split)
    aggs, outs = [], []
    for name, p in probs.items():
        if how == "linear":
            pos = F.lit(p) * (F.col("total") - 1)
            aggs += [F.min(F.when(F.col("le") >= F.floor(pos) + 1, F.col("v"))).alias(f"_{name}_lo"),
                     F.min(F.when(F.col("le") >= F.ceil(pos) + 1, F.col("v"))).alias(f"_{name}_hi"),
                     F.max(pos - F.floor(pos)).alias(f"_{name}_f")]
            lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
            outs.append((lo + (hi - lo) * F.col(f"_{name}_f")).alias(name))
        else:
            at = F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
            aggs.append(F.min(F.when(F.col("le") >= at + 1, F.col("v"))).alias(name))
            outs.append(F.col(name))
    grouped = ranks.groupBy(*keys).agg(*aggs) if keys else ranks.agg(*aggs)
    return grouped.select(*keys, *outs)


def quantiles_of(df: DataFrame, keys: list[str], values: list[str], probs: dict[str, float], how: str = "linear") -> DataFrame:
    """quantiles of several columns in one pass: a column `<name>_<value>` for each."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v"))
                                                for c in values])).alias("_f")).select(*keys, "_f.*")
    q = quantiles(long, [*keys, "_c"], "_v", probs, how)
    wide = [F.max(F.when(F.col("_c") == c, F.col(p))).alias(f"{p}_{c}") for c in values for p in probs]
    return q.groupBy(*keys).agg(*wide) if keys else q.agg(*wide)


def percentile_of(df: DataFrame, keys: list[str], value: str, strict: bool = False,
                  higher_is_better: bool = True, min_values: int = 1, name: str = "pct",
                  scale: float = 100.0) -> DataFrame:
    """Share of the group at or below (strict: below) each row's value."""
    ranks = value_ranks(df, keys, value)
    part = (F.col("le") - F.col("n") if strict else F.col("le")) / F.col("total") * scale
    if not higher_is_better:
        part = scale - part
    ranks = ranks.where(F.col("total") >= min_values).select(
        *[F.col(k).alias(f"_k{k}") for k in keys], F.col("v").alias("_v"), part.alias(name))
    cond = F.col(value).cast("double") == F.col("_v")
    for k in keys:
        cond = (F.col(k) == F.col(f"_k{k}")) & cond
    return df.join(ranks, cond, "left").drop("_v", *[f"_k{k}" for k in keys])


def share_at_or_below(subjects: DataFrame, members: DataFrame, keys: list[str], subject_value: str,
                      value: str, weight: str | None = None, name: str = "pct", scale: float = 1.0) -> DataFrame:
    """Weight share of the members at or below each subject's value, times the scale.

    Subjects enter the rank table with weight 0, so one cumulative sum answers all of them. The scale is applied before
    the division, so a share that lies between two roundings is not moved off its place first.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    m = members.where(F.col(value).isNotNull() & (w > 0)).select(
        *keys, F.col(value).cast("double").alias("_v"), w.alias("_w"))
    s = subjects.where(F.col(subject_value).isNotNull()).select(
        *keys, F.col(subject_value).cast("double").alias("_v"), F.lit(0.0).alias("_w"))
    ranks = value_ranks(m.unionByName(s), keys, "_v", weight="_w").select(
        *[F.col(k).alias(f"_k{k}") for k in keys], F.col("v").alias("_v"),
        F.try_divide(F.col("le") * scale, F.col("total")).alias(name))
    cond = F.col(subject_value).cast("double") == F.col("_v")
    for k in keys:
        cond = (F.col(k) == F.col(f"_k{k}")) & cond
    return subjects.join(ranks, cond, "left").drop("_v", *[f"_k{k}" for k in keys])


def ranked(df: DataFrame, value: str, ident: str, best_is_high: bool = True,
           keys: list[str] | None = None) -> DataFrame:
    """Rank of every row from the favourable end, ties by id."""
    if keys:
        order = F.desc(value) if best_is_high else F.asc(value)
        return df.withColumn("rank", F.row_number().over(
            Window.partitionBy(*keys).orderBy(order, ident)))
    sign = -1.0 if best_is_high else 1.0
    signed = df.where(F.col(value).isNotNull()).withColumn("_s", F.col(value).cast("double") * sign)
    below = value_ranks(signed, [], "_s").select(
        F.col("v").alias("_v"), (F.col("le") - F.col("n")).alias("_below"))
    tie = Window.partitionBy("_s").orderBy(ident)
    return (signed.join(below, F.col("_s") == F.col("_v"))
            .withColumn("rank", F.col("_below") + F.row_number().over(tie))
            .drop("_s", "_v", "_below"))


def class_index(df: DataFrame, breaks: DataFrame, keys: list[str], value: str,
                cols=("q20", "q40", "q60", "q80")) -> DataFrame:
    """Number of breaks the value exceeds."""
    steps = sum([(F.col(value) > F.col(b)).cast("int") for b in cols[1:]],
                (F.col(value) > F.col(cols[0])).cast("int"))
    return _join(df, breaks, keys).withColumn("class_index", steps)


def quintile_breaks(df: DataFrame, keys: list[str], value: str, min_values: int = 5) -> DataFrame:
    """Breaks at floor(p·n) of the sorted values; none below the minimum count."""
    enough = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    q = quantiles(df, keys, value, {"q20": 0.2, "q40": 0.4, "q60": 0.6, "q80": 0.8}, how="index")
    return q.join(enough.where(F.col("_n") >= min_values).drop("_n"), keys, "left_semi")


def top_categories(df: DataFrame, keys: list[str], category: str, keep: int = 12,
                   other: str = "Other", missing: str = "Unspecified",
                   name: str = "shown") -> DataFrame:
    """The most frequent categories by name, the rest as Other."""
    counts = df.where(F.coalesce(F.col(category), F.lit("")) != "").groupBy(*keys, category).count()
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), category)
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select(
        *keys, category, F.lit(True).alias("_top"))
    shown = (F.when(F.coalesce(F.col(category), F.lit("")) == "", missing)
             .when(F.col("_top"), F.col(category)).otherwise(other))
    return df.join(top, [*keys, category], "left").withColumn(name, shown).drop("_top")


def outstanding(districts: DataFrame, modules: DataFrame, markers: DataFrame, has_manifest: str,
                code: str) -> DataFrame:
    """Every (district, module) pair with its state; modules are a short fixed list."""
    from townloom.functions.classify import is_canadian

    pairs = districts.crossJoin(F.broadcast(modules))
    done = markers.select("district_id", "module", F.lit(True).alias("_done"))
    state = (F.when(F.col("us_only") & is_canadian(code), "skip-canada")
             .when(~F.coalesce(F.col(has_manifest), F.lit(False)), "skip-no-manifest")
             .when(F.col("_done"), "skip-already-done").otherwise("todo"))
    return pairs.join(done, ["district_id", "module"], "left").select(
        "district_id", "module", state.alias("state"))


def min_max(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Scaled to 0..1 over the group; a constant column is 0.5."""
    keys = keys or []
    aggs = [F.min(value).alias("_lo"), F.max(value).alias("_hi")]
    span = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    width = F.col("_hi") - F.col("_lo")
    return (_join(df, span, keys)
            .withColumn(name, F.when(width > 0, (F.col(value) - F.col("_lo")) / width)
                        .otherwise(F.lit(0.5))).drop("_lo", "_hi"))


def sample_per_cell(df: DataFrame, cells: list[str], ident: str, budget: int, seed: int = 42
                    ) -> DataFrame:
    """A seeded sample per cell whose size follows the log of the cell's count."""
    counts = df.groupBy(*cells).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum(F.log1p("_n")).alias("_t"))
    quota = counts.crossJoin(F.broadcast(total)).select(
        *cells, F.greatest(F.lit(1), F.round(F.log1p("_n") / F.col("_t") * budget)).alias("_q"))
    w = Window.partitionBy(*cells).orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident)
    return (df.join(quota, cells).withColumn("_r", F.row_number().over(w))
            .where((F.col("_r") <= budget) & (F.col("_r") <= F.col("_q"))).drop("_r", "_q"))


def typical_sample(df: DataFrame, keys: list[str], ident: str, value: str, max_n: int = 16,
                   seed: int = 42) -> DataFrame:
    """Up to max_n rows per group; large groups give half typical and half seeded rows."""
    med = quantiles(df, keys, value, {"_med": 0.5})
    sized = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = df.join(med, keys).join(sized, keys).withColumn("_d", F.abs(F.col(value) - F.col("_med")))
    near = Window.partitionBy(*keys).orderBy("_d", ident)
    some = Window.partitionBy(*keys).orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident)
    large = F.col("_n") > max_n * 2
    closest = d.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= max_n).where(
        (F.col("_r") <= max_n // 2) | ~large)
    rest = (d.where(large).join(closest.select(*keys, ident), [*keys, ident], "left_anti")
            .withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= max_n - max_n // 2))
    return closest.unionByName(rest).drop("_r", "_d", "_med", "_n")


def median_member(df: DataFrame, keys: list[str], ident: str, value: str) -> DataFrame:
    """The member closest to the group's median; ties take the smaller id."""
    med = quantiles(df, keys, value, {"median": 0.5})
    d = df.join(med, keys).withColumn("_d", F.round(F.abs(F.col(value) - F.col("median")), 9))
    return d.groupBy(*keys, "median").agg(
        F.min_by(ident, F.struct("_d", ident)).alias("representative"))


def pick_labels(df: DataFrame, ident: str, name: str, value: str, focus, peers: list[str],
                cap: int) -> DataFrame:
    """Focus, minimum, maximum, nearest to the median, then named peers up to the cap."""
    valid = df.where(F.col(value).isNotNull())
    med = quantiles(valid, [], value, {"_m": 0.5})
    d = valid.crossJoin(F.broadcast(med)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    first = d.agg(F.min_by(ident, F.struct(value, ident)).alias("_lo"),
                  F.min_by(ident, F.struct(-F.col(value), ident)).alias("_hi"),
                  F.min_by(ident, F.struct("_d", ident)).alias("_mid"))
    d = d.crossJoin(F.broadcast(first))
    named = F.lit(False)
    for p in peers:
        named = named | F.lower(F.col(name)).contains(p.lower())
    why = (F.when(F.col(ident) == F.lit(focus), "focus").when(F.col(ident) == F.col("_lo"), "min")
           .when(F.col(ident) == F.col("_hi"), "max").when(F.col(ident) == F.col("_mid"), "median")
           .when(named, "peer"))
    order = (F.when(why == "peer", 1).otherwise(0))
    return (d.withColumn("why", why).where(F.col("why").isNotNull())
            .orderBy(order, ident).limit(cap).select(ident, value, "why"))


def restrict_cohort(df: DataFrame, cohort: DataFrame, ident: str, primary: str, fallback: str
                    ) -> DataFrame:
    """Listed districts only, labelled by type with a fallback."""
    return (df.join(cohort.select(ident), ident, "left_semi")
            .withColumn("label", F.coalesce(F.col(primary), F.col(fallback), F.lit("unlabelled"))))


def flag_filter(df: DataFrame, keys: list[str], duplicate: str, operational: str
                ) -> tuple[DataFrame, DataFrame]:
    """Drop flagged duplicates, then non-operational rows unless the group has no
    operational row at all. Returns the kept rows and a report per group."""
    from townloom.functions.num import tolerant_bool_text

    d = (df.withColumn("_dup", tolerant_bool_text(duplicate))
         .withColumn("_op", tolerant_bool_text(operational)))
    guard = d.groupBy(*keys).agg(F.max(F.when(~F.col("_dup"), F.col("_op"))).alias("_any"))
    d = d.join(guard, keys).withColumn("_any", F.coalesce("_any", F.lit(False)))
    keep = ~F.col("_dup") & (F.col("_op") | ~F.col("_any"))
    report = d.groupBy(*keys).agg(
        F.count("*").alias("n_input"),
        F.count(F.when(F.col("_dup"), 1)).alias("dropped_duplicate"),
        F.count(F.when(~F.col("_dup") & ~keep, 1)).alias("dropped_non_operational"),
        F.max("_any").alias("operational_filter_applied"),
        F.count(F.when(keep, 1)).alias("n_output"))
    return d.where(keep).drop("_dup", "_op", "_any"), report
