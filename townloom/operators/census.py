"""Census, jobs and parcel summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.functions.num import null_if_sentinel
from townloom.operators.ranks import quantiles, value_ranks
from townloom.operators.spatial import KEYS


def demographics(units: DataFrame, weight: str, keys=KEYS) -> DataFrame:
    """A5: overlap-weighted sums, population-weighted means and shares of each district.

    Means skip units without a value or without weighted people. Pass a constant-one weight for
    the time series, which weights every unit fully.
    """
    w = F.coalesce(F.col(weight), F.lit(0.0))
    total = lambda c: F.sum(F.coalesce(null_if_sentinel(c), F.lit(0.0)) * w)

    def mean(c):
        people = F.coalesce(F.col("total_pop"), F.lit(0.0)) * w
        v = null_if_sentinel(c)
        ok = v.isNotNull() & (people > 0)
        return F.try_divide(F.sum(F.when(ok, v * people)), F.sum(F.when(ok, people)))

    edu = sum([total(f"edu_{x}") for x in ("masters", "professional", "doctorate")],
              total("edu_bachelors"))
    pct = lambda part, whole: F.when(whole > 0, F.round(100.0 * part / whole, 1))
    return units.groupBy(*keys).agg(
        F.count("*").alias("units_total"),
        F.round(total("total_pop")).alias("estimated_population"),
        mean("median_age").alias("median_age_pop_weighted"),
        mean("median_household_income").alias("median_household_income_pop_weighted"),
        F.round(total("occupied_total")).alias("occupied_housing_units"),
        pct(total("owner_occupied"), total("occupied_total")).alias("pct_owner_occupied"),
        pct(total("renter_occupied"), total("occupied_total")).alias("pct_renter_occupied"),
        mean("median_home_value").alias("median_home_value_pop_weighted"),
        mean("median_gross_rent").alias("median_gross_rent_pop_weighted"),
        pct(edu, total("edu_total_pop_25plus")).alias("pct_bachelors_or_higher"),
        pct(total("race_white"), total("race_total")).alias("pct_white"),
        pct(total("race_black"), total("race_total")).alias("pct_black"),
        pct(total("race_asian"), total("race_total")).alias("pct_asian"),
        pct(total("hispanic"), total("race_total")).alias("pct_hispanic"),
        pct(total("unemployed"), total("labor_force")).alias("unemployment_rate"))


def jobs_wide(jobs_long: DataFrame, keys: list[str]) -> DataFrame:
    """Sector and earnings columns from long job rows (sector 0-19, band 0-2)."""
    part = lambda cond, name: F.sum(F.when(cond, F.col("jobs")).otherwise(0.0)).alias(name)
    return jobs_long.groupBy(*keys).agg(
        F.sum("jobs").alias("C000"),
        *[part(F.col("sector") == i, c) for i, c in enumerate(V.SECTOR_COLUMNS)],
        *[part(F.col("band") == i, f"CE0{i + 1}") for i in range(3)])


def jobs_summary(blocks: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """Weighted jobs, sector roll-up, shares and top sector.

    Firm columns are used only when present and not all zero.
    """
    w = F.least(F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    have = [c for c in V.JOB_COLUMNS if c in blocks.columns]
    s = blocks.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0.0)) * w).alias(c)
                                    for c in have])
    get = lambda c: F.col(c) if c in have else F.lit(0.0)
    pct = lambda v: F.when(F.col("C000") > 0, F.round(100.0 * v / F.col("C000"), 1))
    sectors = {k: sum([get(c) for c in cs[1:]], get(cs[0])) for k, cs in V.SECTOR_ROLLUP.items()}
    consumer = sum([sectors[k] for k in V.CONSUMER_SECTORS[1:]], sectors[V.CONSUMER_SECTORS[0]])
    firm = [get(c) for c in V.JOB_COLUMNS if c.startswith("CF")]
    firms = sum(firm[1:], firm[0]) > 0
    top = F.array_min(F.array(*[F.struct((-F.round(v, 6)).alias("v"), F.lit(k).alias("k"))
                                for k, v in sectors.items()]))
    return s.select(
        *keys, F.round("C000").alias("jobs_inside"),
        *[F.round(v, 4).alias(f"jobs_{k}") for k, v in sectors.items()],
        F.round(consumer).alias("consumer_serving_jobs"),
        pct(sectors["office_knowledge"]).alias("office_knowledge_pct"),
        pct(consumer).alias("consumer_serving_pct"),
        pct(get("CE03")).alias("pct_jobs_high_earning"),
        pct(get("CE01")).alias("pct_jobs_low_earning"),
        F.when(firms, pct(get("CFA01") + get("CFA02"))).alias("pct_jobs_young_firms"),
        F.when(top["v"] < 0, top["k"]).alias("top_sector"))


def choropleth(jobs: DataFrame, keys: list[str], year: str, value: str, years: list[int]
               ) -> DataFrame:
    """One column per year; the years are given, so no extra job finds them."""
    return jobs.groupBy(*keys).pivot(year, years).agg(F.sum(value)).select(
        *keys, *[F.col(str(y)).alias(f"jobs_{y}") for y in years])


def gini(df: DataFrame, keys: list[str], value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient of the positive values of each group.

    Equal values share consecutive ranks, so the rank sum of a value is known from the counts.
    """
    r = value_ranks(df.where(F.col(value) > 0), keys, value)
    rank_sum = F.col("n") * (F.col("le") - F.col("n") + F.col("le") + 1) / 2.0
    g = r.groupBy(*keys).agg(F.sum(rank_sum * F.col("v")).alias("_c"), F.sum(
        F.col("n") * F.col("v")).alias("_s"), F.max("total").alias("_n"))
    value_of = 2.0 * F.col("_c") / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n")
    return g.select(*keys, F.when(F.col("_n") == 1, 0.0).otherwise(value_of).alias(name))


def parcel_summary(parcels: DataFrame, keys=KEYS) -> DataFrame:
    """One row of parcel measures per district."""
    from townloom.operators.programs import entropy

    k = list(keys)
    acres = F.when(F.col("acres") > 0, F.col("acres"))
    sqft = F.when(F.col("bldg_sqft") > 0, F.col("bldg_sqft"))
    year = F.when((F.col("year_built") > 1700) & (F.col("year_built") < 2050), F.col("year_built"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    base = parcels.groupBy(*k).agg(
        F.count("*").alias("parcel_count"), F.sum(acres).alias("_acres"),
        F.avg(F.when(sqft.isNull(), 1.0).otherwise(0.0)).alias("vacant_share"),
        F.avg(F.when(filled("exemption"), 1.0).otherwise(0.0)).alias("tax_exempt_share"),
        F.avg(sqft / acres).alias("mean_bldg_density_per_acre"),
        F.round(F.avg(nonzero("land_value"))).alias("mean_land_value"),
        F.round(F.avg(nonzero("bldg_value"))).alias("mean_bldg_value"))
    owners = parcels.where(filled("owner") & acres.isNotNull()).groupBy(
        *k, F.upper(F.trim("owner")).alias("owner")).agg(F.sum("acres").alias("owned"))
    w = Window.partitionBy(*k).orderBy(F.desc("owned"), "owner")
    top5 = (owners.withColumn("_r", F.row_number().over(w)).where("_r <= 5").groupBy(*k)
            .agg(F.sum("owned").alias("_top5")))
    med = quantiles(parcels.withColumn("_y", year), k, "_y", {"year_built_median": 0.5}, how="index")
    zoning = entropy(parcels.where(filled("zoning")), k, "zoning", name="zoning_diversity")
    out = base
    for part in (gini(owners, k, "owned", "ownership_gini"), top5, med, zoning):
        out = out.join(part, k, "left")
    return (out.withColumn("top5_owner_share", F.col("_top5") / F.col("_acres"))
            .withColumn("total_acres", F.round("_acres", 2)).drop("_top5", "_acres"))


def top_values(df: DataFrame, value, n: int = 10, keys=KEYS) -> DataFrame:
    """The most frequent values per district, count first, then name."""
    text = F.trim(F.col(value) if isinstance(value, str) else value)
    counts = df.where(F.coalesce(text, F.lit("")) != "").groupBy(*keys, text.alias("value")).agg(
        F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def decade_histogram(parcels: DataFrame, keys=KEYS) -> DataFrame:
    """Parcels per decade of construction."""
    y = F.col("year_built")
    return parcels.where((y > 1700) & (y < 2050)).groupBy(
        *keys, (F.floor(y / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


# --- panels ------------------------------------------------------------------------------------


def acs_panel(long_units: DataFrame, metrics: list[str], keys=KEYS, year: str = "yr") -> DataFrame:
    """Long (district, year, metric, value) with the geography vintage."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double")
                                         .alias("value")) for m in metrics]))
    return (long_units.select(*keys, year, pairs.alias("_m"))
            .select(*keys, year, F.when(F.col(year) >= 2020, 2020).otherwise(2010).alias("vintage"),
                    "_m.metric", "_m.value"))


def slopes(panel: DataFrame, metrics: list[str], keys=KEYS, year: str = "yr") -> DataFrame:
    """Least-squares slope per metric; fewer than two points give 0."""
    return panel.groupBy(*keys).agg(*[
        F.coalesce(F.regr_slope(F.col(m), F.col(year).cast("double")), F.lit(0.0)).alias(f"{m}_trend")
        for m in metrics])


def level_and_trend(panel: DataFrame, area_km2: DataFrame, keys=KEYS, year: str = "yr") -> DataFrame:
    """Latest level and trend features of the demographic and economic panel."""
    k = list(keys)
    last = lambda c: F.coalesce(F.max_by(c, year), F.lit(0.0))
    level = panel.groupBy(*k).agg(last("pop").alias("_pop"),
                                  last("pct_owner").alias("demo_pct_owner_occupied"),
                                  last("income").alias("econ_median_income"),
                                  last("home_value").alias("econ_median_home_value"),
                                  last("rent").alias("econ_median_gross_rent"))
    trend = slopes(panel, ["pop", "pct_owner", "income", "home_value"], keys, year)
    area = F.when(F.col("area_km2") > 0, F.col("area_km2")).otherwise(1.0)
    return (level.join(trend, k).join(area_km2.select(*k, "area_km2"), k, "left")
            .select(*k, (F.col("_pop") / area).alias("demo_pop_density"), "demo_pct_owner_occupied",
                    "econ_median_income", "econ_median_home_value", "econ_median_gross_rent",
                    F.col("pop_trend").alias("demo_pop_trend"),
                    F.col("pct_owner_trend").alias("demo_ownership_trend"),
                    F.col("income_trend").alias("econ_income_trend"),
                    F.col("home_value_trend").alias("econ_home_value_trend")))


def growth(v0: Column, v1: Column, span: Column, digits: int) -> Column:
    """Compound annual growth in percent; NULL without a span or a positive start."""
    return F.when((span > 0) & (v0 > 0), F.round(
        100.0 * (F.pow(v1 / v0, F.lit(1.0) / span) - 1.0), digits))


def series_trend(series: DataFrame, value: str, keys=KEYS, year: str = "yr") -> DataFrame:
    """T4: first, last, change, growth and peak of a yearly series."""
    s = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.min_by(value, year).alias("first"), F.max_by(value, year).alias("last"),
        F.max(value).alias("peak"), F.min_by(year, F.struct(-F.col(value), year)).alias("peak_year"))
    change = F.col("last") - F.col("first")
    return (s.withColumn("change", change)
            .withColumn("pct_change", F.when(F.col("first") > 0,
                                             F.round(100.0 * change / F.col("first"), 1)))
            .withColumn("cagr_pct", growth(F.col("first"), F.col("last"),
                                           (F.col("last_year") - F.col("first_year")).cast("double"),
                                           1)))


def delta_pct(pre: Column, post: Column) -> Column:
    return F.when((pre != 0) & post.isNotNull(), F.round(100.0 * (post - pre) / pre, 1))


def pre_post(series: DataFrame, milestones: DataFrame, jobs: str, shares: list[str], window: int = 3,
             keys=KEYS, year: str = "yr") -> DataFrame:
    """T5: means before and after a milestone year (itself left out), deltas and growth."""
    k = list(keys)
    d = series.join(milestones.select(*k, "milestone"), k)
    pre = F.col(year).between(F.col("milestone") - window, F.col("milestone") - 1)
    post = F.col(year).between(F.col("milestone") + 1, F.col("milestone") + window)
    aggs = []
    for c in [jobs, *shares]:
        aggs += [F.avg(F.when(pre, F.col(c))).alias(f"{c}_pre"),
                 F.avg(F.when(post, F.col(c))).alias(f"{c}_post")]
    for tag, cond in (("pre", pre), ("post", post)):
        y = F.when(cond & F.col(jobs).isNotNull(), F.col(year))
        aggs += [F.min(y).alias(f"_y0{tag}"), F.max(y).alias(f"_y1{tag}"),
                 F.min_by(jobs, y).alias(f"_v0{tag}"), F.max_by(jobs, y).alias(f"_v1{tag}")]
    aggs += [F.min(year).alias("_lo"), F.max(year).alias("_hi")]
    g = d.groupBy(*k, "milestone").agg(*aggs)
    out = []
    for c in [jobs, *shares]:
        a, b = F.col(f"{c}_pre"), F.col(f"{c}_post")
        out += [F.round(a, 1).alias(f"{c}_pre"), F.round(b, 1).alias(f"{c}_post"),
                (delta_pct(a, b) if c == jobs else F.round(b - a, 1)).alias(f"{c}_delta")]
    cagr = lambda t: growth(F.col(f"_v0{t}"), F.col(f"_v1{t}"),
                            (F.col(f"_y1{t}") - F.col(f"_y0{t}")).cast("double"), 2)
    flags = F.array_compact(F.array(
        F.when(F.col("_lo") > F.col("milestone") - 1, "pre_window_unavailable"),
        F.when(F.col("_hi") < F.col("milestone") + 1, "post_window_unavailable")))
    return g.select(*k, "milestone", *out, cagr("pre").alias("cagr_pre"),
                    cagr("post").alias("cagr_post"), flags.alias("flags"))


def acs_pre_post(pre: DataFrame, post: DataFrame, keys=KEYS) -> DataFrame:
    """Change between two census vintages and the reinvestment composite."""
    k = list(keys)
    ren = lambda d, t: d.select(*k, *[F.col(c).alias(f"{c}_{t}") for c in d.columns if c not in k])
    j = ren(pre, "pre").join(ren(post, "post"), k)
    pct = lambda c: delta_pct(F.col(f"{c}_pre"), F.col(f"{c}_post"))
    diff = lambda c: F.round(F.col(f"{c}_post") - F.col(f"{c}_pre"), 1)
    j = j.select(*k, pct("income").alias("income_delta_pct"),
                 pct("home_value").alias("home_value_delta_pct"), pct("rent").alias("rent_delta_pct"),
                 diff("pct_renter").alias("renter_delta"),
                 diff("pct_bachelors").alias("bachelors_delta"),
                 pct("pop").alias("population_delta_pct"))
    parts = F.array_compact(F.array("rent_delta_pct", "home_value_delta_pct", "bachelors_delta"))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts)
    return j.withColumn("reinvestment", F.when(F.size(parts) >= 2, F.round(mean, 2)))


def newest_complete_year(available: DataFrame, touched: DataFrame, keys=KEYS) -> DataFrame:
    """Newest year for which every state a district touches has data."""
    k = list(keys)
    need = touched.select(*k, "state").distinct()
    n = need.groupBy(*k).agg(F.count("*").alias("_n"))
    have = need.join(available.select("state", "yr").distinct(), "state").groupBy(*k, "yr").agg(
        F.count("*").alias("_h"))
    return have.join(n, k).where("_h = _n").groupBy(*k).agg(F.max("yr").alias("yr"))
