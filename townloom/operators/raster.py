"""Pixel tables and cell masks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.functions import vocab as V
from townloom.functions.classify import lookup
from townloom.operators.graph import LINKED_ROWS, connected_components, lowest_reachable
from townloom.operators.ranks import quantiles
from townloom.operators.spatial import KEYS, cell_cover, line_cover, spread_hot_keys
from townloom.session import cut, fan_out, followed


def to_celsius(dn) -> Column:
    """Thermal digital number to degrees; fill is NULL."""
    v = F.col(dn)
    return F.when(v > 0, v * V.SURFACE_TEMP_SCALE + (V.SURFACE_TEMP_OFFSET - 273.15))


def reflectance(dn) -> Column:
    v = F.col(dn)
    return F.when(v > 0, v * V.REFLECTANCE_SCALE + V.REFLECTANCE_OFFSET)


def vegetation_index(red, nir) -> Column:
    """Normalised difference of two bands, clipped to -1..1."""
    r, n = reflectance(red), reflectance(nir)
    return F.least(F.greatest(F.try_divide(n - r, n + r), F.lit(-1.0)), F.lit(1.0))


def tag_inside(pixels: DataFrame, boundaries: DataFrame, size: float, row: str = "row_no",
               col: str = "col_no", keys=KEYS) -> DataFrame:
    """Pixels with a flag telling whether their centre lies in the boundary.

    The test runs once per grid cell, not once per scene and pixel; pixels then meet the covered
    cells in an ordinary equi-join. `size` is the pixel size, cell (0, 0) starts at the origin.
    """
    k = list(keys)
    cells = cell_cover(boundaries, size, k).select(
        *k, F.col("cell_x").alias(col), F.col("cell_y").alias(row), F.lit(True).alias("_in"))
    left, cells, on = spread_hot_keys(pixels, cells, [*k, col, row])
    known = boundaries.select(*k)
    return left.join(cells, on, "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop(
        "_in", "_salt").join(known, k, "left_semi")


def zonal_stats(tagged: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """Count, mean, median, p90, max inside, and the difference to the surroundings."""
    k = list(keys)
    inside = tagged.where("inside")
    a = tagged.groupBy(*k).agg(
        F.count(F.when(F.col("inside"), F.col(value))).alias("count"),
        F.avg(F.when(F.col("inside"), F.col(value))).alias("mean"),
        F.max(F.when(F.col("inside"), F.col(value))).alias("max"),
        F.avg(F.when(~F.col("inside"), F.col(value))).alias("_out"))
    q = quantiles(inside, k, value, {"median": 0.5, "p90": 0.9})
    return a.join(q, k, "left").withColumn(
        "delta", F.round(F.col("mean") - F.col("_out"), 1)).drop("_out")


def class_fractions(tagged: DataFrame, cls: str, keys=KEYS) -> DataFrame:
    """Share of each class among the valid pixels inside."""
    n = tagged.where(F.col("inside") & F.col(cls).isNotNull()).groupBy(*keys, cls).agg(
        F.count("*").alias("_n"))
    t = n.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    return n.join(t, list(keys)).select(*keys, cls, (F.col("_n") / F.col("_t")).alias("fraction"))


def land_cover(tagged: DataFrame, cls: str, keys=KEYS) -> DataFrame:
    """Land-cover percentages, their entropy, and built-up as the impervious proxy."""
    f = class_fractions(tagged, cls, keys).withColumn("bucket", lookup(F.col(cls), V.LAND_COVER,
                                                                       "other"))
    b = f.groupBy(*keys, "bucket").agg(F.sum("fraction").alias("p"))
    names = ("tree", "grass", "crop", "water", "wetland", "bare", "builtup")
    pct = lambda n: F.round(100.0 * F.sum(F.when(F.col("bucket") == n, F.col("p")).otherwise(0.0)), 1)
    return b.groupBy(*keys).agg(
        *[pct(n).alias(f"mth_lc_{n}_pct") for n in names],
        F.round(F.sum(-F.col("p") * F.log("p")), 3).alias("mth_lc_shannon")).withColumn(
        "mth_impervious_pct", F.col("mth_lc_builtup_pct"))


def block_average(pixels: DataFrame, value: str, block: int = 3, keys=KEYS) -> DataFrame:
    """Mean of the finite pixels of each block."""
    b = lambda c: F.floor(F.col(c) / block).cast("long")
    return pixels.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(
        *keys, b("row_no").alias("block_row"), b("col_no").alias("block_col")).agg(
        F.avg(value).alias("value"))


def seasonal_amplitude(tagged: DataFrame, value: str, cloud: str, keys=KEYS, min_months: int = 4
                       ) -> DataFrame:
    """p90 - p10 of monthly means, each month from its least cloudy scene."""
    k = list(keys)
    inside = tagged.where(F.col("inside"))
    scenes = inside.groupBy(*k, "scene_month", "scene").agg(
        F.min(cloud).alias("cloud"), F.avg(value).alias("m"))
    best = scenes.groupBy(*k, "scene_month").agg(F.min_by("m", F.struct("cloud", "scene")).alias("m"))
    a = best.groupBy(*k).agg(F.count("m").alias("months"), F.avg("m").alias("mean"),
                             F.percentile("m", 0.9).alias("_hi"), F.percentile("m", 0.1).alias("_lo"))
    return a.select(*k, "months", F.when(F.col("months") >= min_months, F.col("_hi") - F.col("_lo"))
                    .alias("amplitude"), "mean")


def scalar_field(tagged: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """Mean over all scenes inside, and its difference to the surroundings."""
    k = list(keys)
    per = tagged.groupBy(*k, "scene").agg(
        F.avg(F.when(F.col("inside"), F.col(value))).alias("_in"),
        F.avg(F.when(~F.col("inside"), F.col(value))).alias("_out"))
    return per.groupBy(*k).agg(F.avg("_in").alias("mean_inside"),
                               (F.avg("_in") - F.avg("_out")).alias("delta"))


def hydrology(boundaries: DataFrame, waters: DataFrame, flood_cells: DataFrame,
              coverage: DataFrame, size: float, keys=KEYS) -> DataFrame:
    """Distance to the nearest water line and flooded share.

    Mapped but dry is 0, not mapped is NULL. `waters` has segments x1..y2; `flood_cells` has
    cell_x, cell_y; `coverage` lists the mapped districts.
    """
    k = list(keys)
    seg = F.struct("x1", "y1", "x2", "y2")
    b = boundaries.select(*k, geo.edges("rings").alias("_b"))
    gap = F.sqrt(F.array_min(F.transform("_b", lambda e: geo.segment_gap2(e, F.col("_s")))))
    touch = (F.exists("_b", lambda e: geo.segments_cross(e, F.col("_s")))
             | geo.contains("_b", F.col("_s.x1"), F.col("_s.y1")))
    d = waters.select(*k, seg.alias("_s")).join(b, k).withColumn(
        "_d", F.when(touch, 0.0).otherwise(gap)).groupBy(*k).agg(
        F.round(F.min("_d"), 1).alias("dist_to_water_m"))
    cells = cell_cover(boundaries, size, k)
    wet = flood_cells.select(*k, "cell_x", "cell_y").distinct().withColumn("_w", F.lit(1))
    share = cells.join(wet, [*k, "cell_x", "cell_y"], "left").groupBy(*k).agg(
        F.round(100.0 * F.count("_w") / F.count("*"), 1).alias("_pct"))
    mapped = coverage.select(*k).distinct().withColumn("_mapped", F.lit(True))
    return (boundaries.select(*k).join(d, k, "left").join(share, k, "left").join(mapped, k, "left")
            .select(*k, "dist_to_water_m", F.when(F.col("_mapped"), F.coalesce("_pct", F.lit(0.0)))
                    .alias("floodplain_pct")))


def soil_runoff(soils: DataFrame, keys=KEYS) -> DataFrame:
    """Weighted mean of the hydrologic soil group, 0 (drains) to 1 (runs off)."""
    w = lookup(F.upper(F.trim("hydgrp")), V.SOIL_RUNOFF_WEIGHT)
    s = soils.withColumn("_w", w).where(F.col("_w").isNotNull())
    return s.groupBy(*keys).agg(F.round(F.try_divide(
        F.sum(F.col("_w") * F.col("pct")), F.sum("pct")), 3).alias("runoff"))


def stormwater_burden(cover: DataFrame, runoff: DataFrame, keys=KEYS) -> DataFrame:
    """Impervious share times runoff; NULL when either is missing."""
    return cover.join(runoff, list(keys), "left").select(
        *keys, "mth_impervious_pct", "runoff",
        F.round(F.col("mth_impervious_pct") / 100.0 * F.col("runoff"), 3).alias("stormwater_burden"))


def biodiversity(occurrences: DataFrame, cap: int, keys=KEYS) -> DataFrame:
    """Distinct species and occurrences, with a flag where the source cap was reached."""
    per = occurrences.groupBy(*keys, "species").agg(F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(F.count("*").alias("species_richness"),
                                  F.sum("_n").alias("occurrences")).withColumn(
        "cap_reached", F.col("occurrences") >= cap)


def road_width(highway, lanes) -> Column:
    """Width in metres from the class, or lanes times lane width when larger."""
    base = F.coalesce(lookup(F.col(highway), V.ROAD_WIDTHS_M), F.lit(V.ROAD_DEFAULT_WIDTH_M)).cast(
        "double")
    return F.when(F.col(lanes) > 0, F.greatest(F.col(lanes) * V.LANE_WIDTH_M, base)).otherwise(base)


def layer_cells(layers: dict[str, DataFrame], size: float, keys=KEYS) -> DataFrame:
    """Distinct cells per layer; polygon layers have rings, road layers x1..y2 and half_width.

    Roads of a class that is not (or no longer) built are left out where a layer names classes.
    """
    out = None
    for name, df in layers.items():
        if "highway" in df.columns:
            df = df.where(~F.coalesce(F.col("highway").isin(V.ROAD_SKIPPED_CLASSES), F.lit(False)))
        c = (line_cover(df, size, [*keys], "half_width") if "half_width" in df.columns
             else cell_cover(df, size, [*keys]))
        c = c.distinct().withColumn("layer", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


def plan_footprint(cells: DataFrame, boundaries: DataFrame, size: float, keys=KEYS) -> DataFrame:
    """Area and share of the boundary per layer; layers may overlap."""
    k = list(keys)
    area = cell_cover(boundaries, size, k)
    total = area.groupBy(*k).agg(F.count("*").alias("_t"))
    hit = cells.join(area, [*k, "cell_x", "cell_y"], "left_semi").groupBy(*k, "layer").agg(
        F.count("*").alias("_n"))
    return hit.join(total, k).select(
        *k, "layer", (F.col("_n") * F.lit(size * size)).alias("area_m2"),
        F.round(100.0 * F.col("_n") / F.col("_t"), 2).alias("pct"))


def priority_partition(cells: DataFrame, boundaries: DataFrame, order: list[str], size: float,
                       keys=KEYS) -> DataFrame:
    """Every cell of the boundary claimed once by the first layer in the order, else other."""
    k = list(keys)
    rank = lookup(F.col("layer"), {n: i for i, n in enumerate(order)})
    claim = cells.groupBy(*k, "cell_x", "cell_y").agg(F.min(rank).alias("_p"))
    area = cell_cover(boundaries, size, k)
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in order]), F.col("_p")), F.lit("other"))
    part = area.join(claim, [*k, "cell_x", "cell_y"], "left").groupBy(*k, name.alias("layer")).agg(
        F.count("*").alias("_n"))
    total = part.groupBy(*k).agg(F.sum("_n").alias("_t"))
    return part.join(total, k).select(*k, "layer", "_n", (100.0 * F.col("_n") / F.col("_t")).alias("pct")
                                      ).withColumnRenamed("_n", "cells")


KERNEL_ZERO = 38.7  # bandwidths beyond which exp(-d^2 / 2) is 0 in double precision
KERNEL_TILE = 64  # cells across a tile of the canvas
KERNEL_POINTS = 2048  # distinct points of a block


def kernel_density(points: DataFrame, boundaries: DataFrame, canvas: DataFrame, cell: float, bandwidth: float,
                   cutoff: float = 0.25, min_points: int = 5, category: str | None = None, keys=KEYS) -> DataFrame:
    """Gaussian sum of each category at every cell centre of the canvas, low cells dropped, cells in the boundary kept.

    `canvas` has a box xmin, ymin, xmax, ymax per district. The cutoff is a percentile over all cells of the
    canvas with a density above 0. No kernel is cut short: the factor of x times the factor of y, summed over the
    points of a block, is a matrix product, so blocks of neighbouring points meet tiles of the canvas, and a pair
    is left out only where every kernel value is 0 in double precision. Copies of a point count as a weight.
    """
    import pandas as pd

    k = [*keys, *([category] if category else [])]
    enough = points.groupBy(*k).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points)
    spots = points.join(enough.select(*k), k, "left_semi").groupBy(*k, "x", "y").agg(F.count("*").cast("double").alias("w"))
    side = KERNEL_TILE * cell
    spots = spots.withColumn("_zx", geo.cell_of("x", side)).withColumn("_zy", geo.cell_of("y", side))
    zones = spots.groupBy(*k, "_zx", "_zy").agg(F.ceil(F.count("*") / KERNEL_POINTS).alias("_b"))
    blocks = spots.join(zones, [*k, "_zx", "_zy"]).withColumn("_sub", F.pmod(F.xxhash64("x", "y"), F.col("_b"))).groupBy(
        *k, "_zx", "_zy", "_sub").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.collect_list("w").alias("ws"))
    first, last = (lambda c: geo.cell_of(f"{c}min", cell)), (lambda c: geo.cell_of(f"{c}max", cell))
    extent = canvas.select(*keys, first("x").alias("_x0"), last("x").alias("_x1"), first("y").alias("_y0"), last("y").alias("_y1"))
    reach = math.ceil(KERNEL_ZERO * bandwidth / side)
    tile = lambda c: F.floor(F.col(c) / KERNEL_TILE)
    near = lambda z, lo, hi: F.filter(F.sequence(tile(lo), tile(hi)), lambda t: F.abs(t - F.col(z)) <= reach)
    pairs = blocks.join(extent, list(keys)).withColumn("_tx", F.explode(near("_zx", "_x0", "_x1"))).withColumn(
        "_ty", F.explode(near("_zy", "_y0", "_y1")))
    pairs = fan_out(pairs.drop("_zx", "_zy", "_sub"), *k, "_tx", "_ty")
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}

    def sums(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                row = dict(zip(pdf.columns, row))
                axis = lambda c: np.arange(max(row[f"_{c}0"], row[f"_t{c}"] * KERNEL_TILE),
                                           min(row[f"_{c}1"], row[f"_t{c}"] * KERNEL_TILE + KERNEL_TILE - 1) + 1)
                cx, cy = axis("x"), axis("y")
                factor = lambda at, p: np.exp(-((at[:, None] + 0.5) * cell - np.asarray(p)[None, :]) ** 2 / (2 * bandwidth ** 2))
                total = (factor(cx, row["xs"]) * np.asarray(row["ws"])) @ factor(cy, row["ys"]).T
                i, j = np.nonzero(total)
                if len(i):
                    yield pd.DataFrame({**{c: [row[c]] * len(i) for c in k}, "cell_x": cx[i], "cell_y": cy[j], "density": total[i, j]})

    schema = ", ".join(f"{c} {kinds[c]}" for c in k) + ", cell_x bigint, cell_y bigint, density double"
    dens = pairs.mapInPandas(sums, schema).groupBy(*k, "cell_x", "cell_y").agg(F.sum("density").alias("density"))
    limit = quantiles(dens, k, "density", {"_q": cutoff})
    inside = cell_cover(boundaries, cell, list(keys))
    return (dens.join(limit, k).where(F.col("density") >= F.col("_q")).drop("_q")
            .join(inside, [*keys, "cell_x", "cell_y"], "left_semi"))


def neighbours4(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Pairs of adjacent cells (right and down), as ids usable by the component search."""
    k = list(keys)
    ident = cells.select(*k, "cell_x", "cell_y", cell_id("cell_x", "cell_y").alias("src"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(0).alias("j")),
                             F.struct(F.lit(0).alias("i"), F.lit(1).alias("j")))).alias("_o")
    moved = ident.select(*k, "src", (F.col("cell_x")).alias("_x"), (F.col("cell_y")).alias("_y"), step)
    moved = moved.select(*k, F.col("src"), (F.col("_x") + F.col("_o.i")).alias("cell_x"),
                         (F.col("_y") + F.col("_o.j")).alias("cell_y"))
    return moved.join(ident.withColumnRenamed("src", "dst"), [*k, "cell_x", "cell_y"]).select(
        *k, "src", "dst")


def cell_id(x, y) -> Column:
    return (F.col(x) + 1048576) * 4194304 + (F.col(y) + 1048576)


def mask_components(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Connected components (4 neighbours) of a cell mask, with their size in cells."""
    nodes = cells.select(*keys, cell_id("cell_x", "cell_y").alias("node"))
    return connected_components(nodes, neighbours4(cells, keys), keys)


def part_sizes(cells: np.ndarray) -> np.ndarray:
    """Cells of each connected part (4 neighbours) of a mask given as a matrix of booleans."""
    height, width = cells.shape
    flat = np.zeros((height, width + 1), bool)  # a free column, so that stretches end with their row
    flat[:, :-1] = cells
    flat = flat.ravel()
    if not flat.any():
        return np.zeros(0, np.int64)
    begins = flat.copy()
    begins[1:] &= ~flat[:-1]
    stretch = np.cumsum(begins) - 1
    both = flat[:-(width + 1)] & flat[width + 1:]
    a, b = stretch[:-(width + 1)][both], stretch[width + 1:][both]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    low = lowest_reachable(a[fresh], b[fresh], int(stretch[-1]) + 1)
    sizes = np.bincount(low[stretch[flat]])
    return sizes[sizes > 0]


def box_metrics(boxes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The measures of one district from the boxes of its mask and of its canvas."""
    x, y = boxes["_x0"].min(), boxes["_y0"].min()
    shape = boxes["_y1"].max() - y + 1, boxes["_x1"].max() - x + 1

    def filled(rows):  # corners of boxes, summed up in both directions
        grid = np.zeros(shape, np.int64)
        for at_y, at_x, sign in (("_y0", "_x0", 1), ("_y1", "_x0", -1), ("_y0", "_x1", -1), ("_y1", "_x1", 1)):
            np.add.at(grid, (boxes[at_y][rows] - y, boxes[at_x][rows] - x), sign)
        return grid.cumsum(0).cumsum(1)[:-1, :-1] > 0

    mine = boxes["_canvas"].astype(bool)
    canvas, mask = filled(mine), filled(~mine)
    sizes, holes = part_sizes(mask), part_sizes(canvas & ~mask)
    n = len(sizes)
    row = {"_t": canvas.sum(), "_n": sizes.sum(), "component_count": n, "component_mean": sizes.mean() if n else 0.0,
           "component_median": np.median(sizes) if n else 0.0, "component_max": sizes.max(initial=0), "largest_void": holes.max(initial=0)}
    return {c: np.full(int(mine.any()), v) for c, v in row.items()}


def field_metrics(mask: DataFrame, canvas: DataFrame, keys=KEYS, limit: int = LINKED_ROWS) -> DataFrame:
    """Coverage, component sizes and largest void of a mask on a canvas of cells.

    `mask` has stretches of cells as `cell_ranges` gives them, `canvas` a box of cells of each district, from x_first and
    y_first up to, not including, x_end and y_end. A district whose cells and stretches are at most `limit` is drawn and
    measured by one task, so its cells are never rows; larger ones are measured cell by cell.
    """
    k = list(keys)
    box = lambda y0, y1, x0, x1, whole: [F.col(y0).cast("long").alias("_y0"), (F.col(y1) if isinstance(y1, str) else y1).cast("long").alias(
        "_y1"), F.col(x0).cast("long").alias("_x0"), F.col(x1).cast("long").alias("_x1"), F.lit(whole).alias("_canvas")]
    rows = cut(mask.select(*k, *box("cell_y", F.col("cell_y") + 1, "_first", "_end", 0)).unionByName(
        canvas.select(*k, *box("y_first", "y_end", "x_first", "x_end", 1))).where("_y0 < _y1 and _x0 < _x1"))
    spread = lambda c: F.max(f"_{c}1") - F.min(f"_{c}0")
    crowded = cut(rows.groupBy(*k).agg(F.greatest(F.count("*"), spread("x") * spread("y")).alias("_c")).where(F.col("_c") > limit).select(*k))
    large = None if crowded.isEmpty() else rows.join(crowded, k, "left_semi")
    kind = {"_t": "_y0", "_n": "_y0", "component_count": "_y0", "component_mean": "double", "component_median": "double",
            "component_max": "_y0", "largest_void": "_y0"}
    out = followed(rows if large is None else rows.join(crowded, k, "left_anti"), k, box_metrics, **kind)
    some = lambda c: F.when(F.col("component_count") > 0, F.col(c)).alias(c)
    out = out.select(*k, (F.col("_n") / F.col("_t")).alias("coverage"), *map(some, (
        "component_count", "component_mean", "component_median", "component_max")), "largest_void")
    if large is not None:
        cells = large.select(*k, "_canvas", F.explode(F.sequence("_y0", F.col("_y1") - 1)).alias("cell_y"), "_x0", "_x1").select(
            *k, "_canvas", F.explode(F.sequence("_x0", F.col("_x1") - 1)).alias("cell_x"), "cell_y").distinct()
        split = lambda whole: cells.where(F.col("_canvas") == whole).drop("_canvas")
        out = out.unionByName(_field_metrics_by_cells(split(0), split(1), k))
    return out


def _field_metrics_by_cells(mask: DataFrame, canvas: DataFrame, k: list[str]) -> DataFrame:
    total = canvas.groupBy(*k).agg(F.count("*").alias("_t"))
    filled = mask_components(mask, k).groupBy(*k, "component").agg(F.count("*").alias("size"))
    void = canvas.join(mask, [*k, "cell_x", "cell_y"], "left_anti")
    holes = mask_components(void, k).groupBy(*k, "component").agg(F.count("*").alias("size"))
    f = filled.groupBy(*k).agg(F.sum("size").alias("_n"), F.count("*").alias("component_count"),
                               F.avg("size").alias("component_mean"),
                               F.max("size").alias("component_max"))
    med = quantiles(filled, k, "size", {"component_median": 0.5})
    h = holes.groupBy(*k).agg(F.max("size").alias("largest_void"))
    return (total.join(f, k, "left").join(med, k, "left").join(h, k, "left")
            .select(*k, (F.coalesce("_n", F.lit(0)) / F.col("_t")).alias("coverage"),
                    "component_count", "component_mean", "component_median", "component_max",
                    F.coalesce("largest_void", F.lit(0)).alias("largest_void")))


def fractal_dimension(mask: DataFrame, sizes=(2, 4, 8, 16, 32, 64, 128, 256), keys=KEYS) -> DataFrame:
    """Box-counting dimension, the negative slope of log count over log size."""
    boxes = mask.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(s).alias("s"), F.floor(F.col("cell_x") / s).alias("bx"),
        F.floor(F.col("cell_y") / s).alias("by")) for s in sizes])).alias("_b"))
    n = boxes.select(*keys, "_b.*").distinct().groupBy(*keys, "s").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg((-F.regr_slope(F.log("n"), F.log(F.col("s").cast("double"))))
                                .alias("fractal_dimension"))


def texture(canvas: DataFrame, keys=KEYS) -> DataFrame:
    """Co-occurrence contrast, homogeneity and energy of a 0/1 mask, mean of two directions.

    `canvas` has cell_x, cell_y and level (0 or 1); levels count as 0 and 255.
    """
    k = list(keys)
    c = canvas.select(*k, "cell_x", "cell_y", F.col("level").alias("b"))
    out = None
    for name, i, j in (("h", 1, 0), ("v", 0, 1)):
        a = canvas.select(*k, (F.col("cell_x") + i).alias("cell_x"),
                          (F.col("cell_y") + j).alias("cell_y"), F.col("level").alias("a"))
        pairs = a.join(c, [*k, "cell_x", "cell_y"])
        differ = F.avg((F.col("a") != F.col("b")).cast("double"))
        ones = F.avg(((F.col("a") == 1) & (F.col("b") == 1)).cast("double"))
        p = pairs.groupBy(*k).agg(differ.alias("d"), ones.alias("o"))
        zeros = 1 - F.col("d") - F.col("o")
        p = p.select(*k, (F.col("d") * 255.0 * 255.0).alias(f"c{name}"),
                     (1 - F.col("d") + F.col("d") / (1 + 255.0 * 255.0)).alias(f"m{name}"),
                     F.sqrt(zeros * zeros + F.col("o") * F.col("o") + F.col("d") * F.col("d") / 2)
                     .alias(f"e{name}"))
        out = p if out is None else out.join(p, k)
    mean = lambda t: (F.col(f"{t}h") + F.col(f"{t}v")) / 2
    return out.select(*k, mean("c").alias("contrast"), mean("m").alias("homogeneity"),
                      mean("e").alias("energy"))


def line_alignment(mask: DataFrame, keys=KEYS, angles: int = 36, threshold: float = 0.3, near_angle: float = 10.0,
                   near_offset: int = 9, peaks: int | None = None) -> DataFrame:
    """How far the strongest straight lines of the mask's edge are horizontal or vertical.

    Edge cells (a neighbour is empty) vote for (angle, offset). A bin is a peak if it has at least `threshold` of
    its district's most votes and no bin within `near_angle` degrees and `near_offset` cells has more, or as
    many and comes before it by angle, then offset. Beyond 180 degrees angles go on at 0 with the opposite offset.
    Votes are copied to the neighbouring angles first; then a window over offsets sees all bins near each.
    `peaks` keeps that many strongest peaks of a district.
    """
    k = list(keys)
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                               for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("_o")
    around = mask.select(*k, "cell_x", "cell_y", step).select(
        *k, F.col("cell_x").alias("ox"), F.col("cell_y").alias("oy"),
        (F.col("cell_x") + F.col("_o.i")).alias("cell_x"),
        (F.col("cell_y") + F.col("_o.j")).alias("cell_y"))
    edge = around.join(mask, [*k, "cell_x", "cell_y"], "left_anti").select(
        *k, F.col("ox"), F.col("oy")).distinct()
    vote = edge.select(*k, "ox", "oy", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("t"))
    rad = F.radians(F.col("t") * F.lit(180.0 / angles))
    # rounded twice: offsets that are halves but for the last bit go the same way everywhere
    rho = F.round(F.round(F.col("ox") * F.cos(rad) + F.col("oy") * F.sin(rad), 6)).cast("int")
    acc = cut(vote.groupBy(*k, "t", rho.alias("rho")).agg(F.count("*").alias("votes")))
    turn = int(near_angle * angles // 180)
    moved = acc.select(*k, "t", "rho", "votes", F.explode(F.sequence(F.lit(-turn), F.lit(turn))).alias("_d"))
    at = F.col("t") + F.col("_d")
    over = (at < 0) | (at >= angles)
    moved = moved.select(*k, F.pmod(at, F.lit(angles)).alias("t"), F.when(over, -F.col("rho")).otherwise(F.col("rho")).alias("rho"),
                         (F.col("_d") == 0).alias("_own"), F.struct("votes", (-F.col("t")).alias("t"), (-F.col("rho")).alias("rho")).alias("_bin"))
    beside = Window.partitionBy(*k, "t").orderBy("rho").rangeBetween(-near_offset, near_offset)
    strong = moved.withColumn("_best", F.max("_bin").over(beside)).where(F.col("_own") & (F.col("_best") == F.col("_bin")))
    top = acc.groupBy(*k).agg(F.max("votes").alias("_m"))
    strong = strong.select(*k, "t", "rho", F.col("_bin.votes").alias("votes")).join(top, k).where(
        F.col("votes") >= threshold * F.col("_m"))
    if peaks is not None:
        w = Window.partitionBy(*k).orderBy(F.desc("votes"), "t", "rho")
        strong = strong.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= peaks)
    deg = F.col("t") * F.lit(180.0 / angles)
    near = lambda a: F.exp(-(deg - a) * (deg - a) / 200.0)
    return strong.groupBy(*k).agg(
        F.count("*").alias("line_count"), (F.avg(near(0.0) + near(180.0)) / 2).alias("h_score"),
        F.avg(near(90.0)).alias("v_score"))


def green_patches(pixels: DataFrame, boundaries: DataFrame, size: float, keys=KEYS) -> DataFrame:
    """Large vegetated patches touching the boundary, distance to the nearest, edge density."""
    from townloom.functions.shapes import outline_gap

    k = list(keys)
    green = pixels.where(F.col("cover").isin(V.GREEN_CLASSES)).select(
        *k, F.col("col_no").alias("cell_x"), F.col("row_no").alias("cell_y")).distinct()
    comp = mask_components(green, keys)
    sized = comp.groupBy(*k, "component").agg(F.count("*").alias("_n")).where(
        F.col("_n") * size * size / 1e4 >= V.GREEN_PATCH_MIN_HA)
    cells = green.withColumn("node", cell_id("cell_x", "cell_y")).join(comp, [*k, "node"]).join(
        sized, [*k, "component"], "left_semi")
    b = boundaries.select(*k, geo.edges("rings").alias("_b"), geo.area("rings").alias("_a"))
    x0, y0 = F.col("cell_x") * F.lit(size), F.col("cell_y") * F.lit(size)
    ring = geo.ring_from((x0, y0), (x0 + size, y0), (x0 + size, y0 + size), (x0, y0 + size), (x0, y0))
    gap = cells.join(b, k).withColumn("_d", outline_gap(geo.segments(ring), F.col("_b")))
    near = gap.groupBy(*k, "component").agg(F.min("_d").alias("_d"))
    pairs = neighbours4(cells, keys).groupBy(*k, F.col("src").alias("node")).agg(
        F.count("*").alias("_p"))
    shared = cells.join(pairs, [*k, "node"], "left").groupBy(*k, "component").agg(
        (4 * F.count("*") - 2 * F.sum(F.coalesce("_p", F.lit(0)))).alias("_edge"))
    j = near.join(shared, [*k, "component"]).groupBy(*k).agg(
        F.round(F.min("_d"), 1).alias("dist_to_green_patch_m"),
        F.count(F.when(F.col("_d") == 0, 1)).alias("green_patch_count"),
        F.sum(F.when(F.col("_d") == 0, F.col("_edge") * F.lit(size)).otherwise(0.0)).alias("_e"))
    return (b.select(*k, "_a").join(j, k, "left")
            .select(*k, "dist_to_green_patch_m", F.coalesce("green_patch_count", F.lit(0)).alias(
                "green_patch_count"), F.round(F.coalesce("_e", F.lit(0.0)) / (F.col("_a") / 1e4), 2)
                    .alias("green_edge_density_m_per_ha")))


def nature_block(canopy: DataFrame, green: DataFrame, air: DataFrame, keys=KEYS) -> DataFrame:
    """Canopy with its reliability gate, green and blue shares and air medians."""
    k = list(keys)
    ok = ((F.col("valid_pixels") >= V.CANOPY_MIN_PIXELS)
          & (F.col("valid_fraction") >= V.CANOPY_MIN_FRACTION))
    return canopy.withColumn("height_reliable", F.coalesce(ok, F.lit(False))).join(
        green, k, "full").join(air, k, "full")
