"""Spatial joins as equi-joins on tiles.

Points get the tile they lie in; polygons are repeated for each tile of their bounding box,
grown by the search distance. The join is an ordinary equi-join on (keys, tile) with the exact
geometric test as an extra condition, so every join type works, Catalyst picks the physical
join, and a point meets a polygon in exactly one tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.session import fan_out, is_small

KEYS = ("district_id",)
HOT_CHECK_BYTES = 512 * 1024 * 1024
HOT_MIN_ROWS = 1_000_000


def atomic_columns(df: DataFrame) -> list[str]:
    plain = ("array", "map", "struct", "binary")
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in plain]


def spread_hot_keys(left: DataFrame, right: DataFrame, on: list[str], force_rows: int | None = None
                    ) -> tuple[DataFrame, DataFrame, list[str]]:
    """Split keys of the left side that hold too many rows over salts; repeat the right side.

    A left side below the checked size fits into one task and is left alone. At most a
    thousand keys can hold more than a thousandth of the rows, so the hot list is small.
    """
    if force_rows is None and is_small(left, HOT_CHECK_BYTES):
        return left, right, on
    counts = left.groupBy(*on).count()
    if force_rows is None:
        total = counts.agg(F.sum("count")).first()[0] or 0
        limit = max(HOT_MIN_ROWS, total // 1000)
    else:
        limit = force_rows
    hot = counts.where(F.col("count") > limit).select(
        *on, F.ceil(F.col("count") / limit).cast("int").alias("_parts"))
    rows = hot.collect()
    if not rows:
        return left, right, on
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, hot.schema))
    salt = F.pmod(F.xxhash64(*atomic_columns(left)), F.coalesce("_parts", F.lit(1))).cast("int")
    left = left.join(hot, on, "left").withColumn("_salt", salt).drop("_parts")
    right = (right.join(hot, on, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(
                 F.col("_parts") - 1, F.lit(0)))))
             .drop("_parts"))
    return left, right, on + ["_salt"]


def tiles_of_box(box: Column, tile: float, grow: float = 0.0) -> Column:
    """Array of (tx, ty) structs covering a box."""
    span = lambda lo, hi: F.sequence(F.floor((lo - grow) / tile).cast("long"),
                                     F.floor((hi + grow) / tile).cast("long"))
    return geo.let(box, lambda b: F.flatten(F.transform(
        span(b["xmin"], b["xmax"]), lambda tx: F.transform(
            span(b["ymin"], b["ymax"]), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty"))))))


def spatial_join(points: DataFrame, polygons: DataFrame, carry: list[str], how: str = "inner",
                 within: float | None = None, tile: float = 250.0, keys=KEYS,
                 x: str = "x", y: str = "y", distance_as: str | None = None,
                 force_rows: int | None = None) -> DataFrame:
    """Points joined to polygons that contain them, or lie within a distance.

    `carry` lists the polygon columns to keep. With `within`, the edge distance replaces the
    buffer polygon. `how` may be inner, left, left_semi or left_anti.
    """
    grow = within or 0.0
    left = (points.withColumn("_tx", geo.cell_of(x, tile)).withColumn("_ty", geo.cell_of(y, tile)))
    tiles = F.explode(tiles_of_box(geo.bbox("rings"), tile, grow)).alias("_t")
    right = (polygons.select(*keys, *[F.col(v) for v in carry],
                             geo.edges("rings").alias("_edges"), tiles)
             .withColumn("_tx", F.col("_t.tx")).withColumn("_ty", F.col("_t.ty")).drop("_t"))
    left, right, on = spread_hot_keys(left, right, [*keys, "_tx", "_ty"], force_rows)
    right = right.select(*[F.col(k).alias(f"_r{k}") for k in on],
                         *[v for v in right.columns if v not in on])
    if within is None:
        exact = geo.contains("_edges", x, y)
    else:
        exact = geo.distance("_edges", x, y) <= within
    cond = exact
    for k in on:
        cond = (F.col(k) == F.col(f"_r{k}")) & cond
    out = left.join(right, cond, how)
    if distance_as:
        out = out.withColumn(distance_as, geo.distance("_edges", x, y))
    keep = points.columns + (list(carry) if how in ("inner", "left") else [])
    return out.select(*keep, *([distance_as] if distance_as else []))


def assign_zone(df: DataFrame, boundaries: DataFrame, x: str = "x", y: str = "y",
                keys=KEYS) -> DataFrame:
    """Interior / exterior of the district boundary, one boundary per district."""
    edge = boundaries.select(*keys, geo.edges("rings").alias("_b"))
    left, edge, on = spread_hot_keys(df, edge, list(keys))
    return (left.join(edge, on, "left").drop("_salt")
            .withColumn("zone", F.when(geo.contains("_b", x, y), "interior").otherwise("exterior"))
            .drop("_b"))


def nearest_polygon(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str,
                    max_distance: float = 25.0, tile: float = 250.0, keys=KEYS) -> DataFrame:
    """Nearest polygon within a distance; equal distances keep every polygon."""
    near = spatial_join(points, polygons, [poly_id], within=max_distance, tile=tile, keys=keys,
                        distance_as="distance_m")
    w = Window.partitionBy(*keys, point_id).orderBy(F.round("distance_m", 6))
    return near.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def _row_stretches(polygons: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """The stretches _lo to _hi inside the polygon along the middle of each row of cells."""
    rows = geo.let(geo.bbox("rings"), lambda b: F.sequence(
        F.floor(b["ymin"] / size).cast("long"), F.floor(b["ymax"] / size).cast("long")))
    y = geo.cell_centre("cell_y", size)
    crossings = F.array_sort(F.transform(
        F.filter("_e", lambda s: (s["y1"] > y) != (s["y2"] > y)),
        lambda s: (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
    per_row = polygons.select(*keep, geo.edges("rings").alias("_e"), F.explode(rows).alias("cell_y")).select(
        *keep, "cell_y", crossings.alias("_x"))
    # outer generators add no filter that would compute the crossings twice
    starts = F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("_x") - 2, F.lit(0)), F.lit(2)))
    return fan_out(per_row, *keep, "cell_y").select(*keep, "cell_y", "_x", starts.alias("_i")).select(
        *keep, "cell_y", F.get("_x", F.col("_i")).alias("_lo"), F.get("_x", F.col("_i") + 1).alias("_hi"))


def cell_ranges(polygons: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """cell_cover with the cells of a stretch in one row: from _first up to, not including, _end."""
    def below(v):  # cells whose centre is below v, by the comparison of cell_cover
        low = F.floor(F.col(v) / size).cast("long") - 1
        return low + sum(((geo.cell_centre(low + i, size) < F.col(v)).cast("long") for i in (1, 2)),
                         (geo.cell_centre(low, size) < F.col(v)).cast("long"))

    return _row_stretches(polygons, size, keep).select(
        *keep, "cell_y", below("_lo").alias("_first"), below("_hi").alias("_end")).where("_first < _end")


def cell_cover(polygons: DataFrame, size: float, keep: list[str]) -> DataFrame:
    """Cells whose centre lies in the polygon; the basis of every overlay here.

    Filled row by row: the edges crossing the middle of a row, in order, give the stretches
    that lie inside, so the work follows the outline and the covered cells, not all cells of the
    box times all edges. Rows are spread one by one, so neither a polygon nor its district stays
    in one task, and no array is longer than the crossings of one row.
    """
    stretches = _row_stretches(polygons, size, keep)
    wide = F.explode_outer(F.sequence(F.floor(F.col("_lo") / size).cast("long") - 1,
                                      F.floor(F.col("_hi") / size).cast("long") + 1))
    centre = geo.cell_centre("cell_x", size)
    return (stretches.select(*keep, "cell_y", "_lo", "_hi", wide.alias("cell_x"))
            .where((centre >= F.col("_lo")) & (centre < F.col("_hi"))).select(*keep, "cell_x", "cell_y"))


def line_cover(lines: DataFrame, size: float, keep: list[str], half_width: str) -> DataFrame:
    """Cells whose centre lies within half the width of a segment x1, y1 - x2, y2."""
    w = F.col(half_width)
    ends = ["x1", "y1", "x2", "y2", half_width]
    lines = fan_out(lines.select(*dict.fromkeys([*keep, *ends])), *keep, *ends[:4])
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - w) / size).cast("long"),
                                             F.floor((F.greatest(a, b) + w) / size).cast("long")))
    cells = lines.withColumn("cell_x", span("x1", "x2")).withColumn("cell_y", span("y1", "y2"))
    near = geo.point_segment_distance2(F.struct("x1", "y1", "x2", "y2"), geo.cell_centre("cell_x", size),
                                       geo.cell_centre("cell_y", size)) <= w * w
    return cells.where(near).select(*keep, "cell_x", "cell_y")


def largest_overlap(targets: DataFrame, sources: DataFrame, target_id: str, source_id: str,
                    size: float = 1.0, keys=KEYS) -> DataFrame:
    """The source polygon sharing most cells with each target; ties take the smaller id."""
    a = cell_cover(targets, size, [*keys, target_id])
    b = cell_cover(sources, size, [*keys, source_id])
    pairs = (a.join(b, [*keys, "cell_x", "cell_y"])
             .groupBy(*keys, target_id, source_id).agg(F.count("*").alias("cells")))
    w = Window.partitionBy(*keys, target_id).orderBy(F.desc("cells"), source_id)
    return (pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
            .withColumn("overlap_m2", F.col("cells") * F.lit(size * size)))


def transfer_first(targets: DataFrame, polygons: DataFrame, target_id: str, order: str,
                   attributes: list[str], x: str = "cx", y: str = "cy", keys=KEYS) -> DataFrame:
    """Attributes of the first polygon (in a declared order) that contains the centroid."""
    hits = spatial_join(targets, polygons, [order, *attributes], x=x, y=y, keys=keys)
    picked = hits.groupBy(*keys, target_id).agg(
        *[F.min_by(F.struct(order, *attributes), order).alias("_p")])
    picked = picked.select(*keys, target_id, *[F.col(f"_p.{a}").alias(a) for a in
                                               [order, *attributes]])
    return targets.select(*keys, target_id).join(picked, [*keys, target_id], "left")


def overlap_exact(units: DataFrame, windows: DataFrame, unit_id: str, keys=KEYS) -> DataFrame:
    """Exact share of each unit inside a simple window, and whether all of it is inside."""
    from townloom.functions.shapes import polygon_overlap

    win = windows.select(*keys, F.col("rings").alias("_w"))
    out = units.join(win, list(keys))
    shared = polygon_overlap(F.col("rings")[0], F.col("_w")[0])
    out = out.withColumn("_shared", shared).withColumn("_area", geo.area("rings"))
    ratio = F.least(F.greatest(F.col("_shared") / F.col("_area"), F.lit(0.0)), F.lit(1.0))
    return (out.withColumn("overlap_m2", F.col("_shared"))
            .withColumn("overlap_ratio", ratio)
            .withColumn("fully_inside", F.col("overlap_ratio") >= F.lit(1 - 1e-9))
            .drop("_w", "_shared", "_area"))


def overlap_by_cells(units: DataFrame, windows: DataFrame, unit_id: str, size: float,
                     keys=KEYS) -> DataFrame:
    """Overlap share for any polygons as a ratio of cells; error is about edge x cell size."""
    u = cell_ranges(units, size, [*keys, unit_id])
    # windows of one key may overlap: of each range what is beyond the ranges that begin before it
    before = Window.partitionBy(*keys, "cell_y").orderBy("_first", "_end").rowsBetween(Window.unboundedPreceding, -1)
    w = cell_ranges(windows, size, [*keys]).withColumn("_from", F.greatest("_first", F.max("_end").over(before))).where(
        "_from < _end").select(*keys, "cell_y", "_from", F.col("_end").alias("_to"))
    common = F.greatest(F.least("_end", "_to") - F.greatest("_first", "_from"), F.lit(0))
    met = u.join(w, [*keys, "cell_y"]).select(*keys, unit_id, F.lit(0).cast("long").alias("_all"), common.alias("_in"))
    return (u.select(*keys, unit_id, (F.col("_end") - F.col("_first")).alias("_all"), F.lit(0).cast("long").alias("_in"))
            .unionByName(met).groupBy(*keys, unit_id)
            .agg((F.sum("_in") / F.sum("_all")).alias("overlap_ratio"),
                 (F.sum("_in") * F.lit(size * size)).alias("overlap_m2")))


def dominant_unit(overlaps: DataFrame, unit_id: str, keys=KEYS, floor_m2: float = 1.0) -> DataFrame:
    """The unit with the largest overlap above a floor."""
    return (overlaps.where(F.col("overlap_m2") > floor_m2).groupBy(*keys)
            .agg(F.max_by(F.struct(unit_id, "overlap_m2"),
                          F.struct("overlap_m2", -F.col(unit_id))).alias("_m"))
            .select(*keys, F.col(f"_m.{unit_id}").alias("dominant_unit"),
                    F.col("_m.overlap_m2").alias("overlap_m2")))


def left_join_filled(left: DataFrame, right: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Left join on geographic ids; only the listed value columns are filled."""
    return left.join(right, on, "left").fillna(fill)


def points_within(a: DataFrame, b: DataFrame, radius: float, how: str = "left_semi", keys=KEYS,
                  carry: list[str] | None = None) -> DataFrame:
    """Points of a that have a point of b within a radius (or the pairs for how='inner')."""
    tile = max(4 * radius, 1.0)  # most points reach one or two tiles, four at most
    left = a.withColumn("_tx", geo.cell_of("x", tile)).withColumn("_ty", geo.cell_of("y", tile))
    spot = F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    right = (b.where("x IS NOT NULL AND y IS NOT NULL").select(
        *keys, F.col("x").alias("_x"), F.col("y").alias("_y"), *(carry or []),
        F.explode(tiles_of_box(spot, tile, radius * (1 + 1e-9))).alias("_t"))
        .withColumn("_tx", F.col("_t.tx")).withColumn("_ty", F.col("_t.ty")).drop("_t"))
    left, right, on = spread_hot_keys(left, right, [*keys, "_tx", "_ty"])
    right = right.select(*[F.col(k).alias(f"_r{k}") for k in on],
                         *[v for v in right.columns if v not in on])
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    cond = dx * dx + dy * dy <= radius * radius
    for k in on:
        cond = (F.col(k) == F.col(f"_r{k}")) & cond
    out = left.join(right, cond, how)
    return out.select(*a.columns, *((carry or []) if how in ("inner", "left") else []))


def match_counts(a: DataFrame, b: DataFrame, radius: float, keys=KEYS) -> DataFrame:
    """Per district, rows of a with a partner in b, rows of a without, rows of b without."""
    hit_a = points_within(a, b, radius, keys=keys).groupBy(*keys).agg(F.count("*").alias("matched"))
    only_a = points_within(a, b, radius, "left_anti", keys).groupBy(*keys).agg(
        F.count("*").alias("only_left"))
    only_b = points_within(b, a, radius, "left_anti", keys).groupBy(*keys).agg(
        F.count("*").alias("only_right"))
    return (hit_a.join(only_a, list(keys), "full").join(only_b, list(keys), "full")
            .fillna(0, ["matched", "only_left", "only_right"]))


def near_far(points: DataFrame, polygons: DataFrame, within: float, tile: float = 250.0,
             keys=KEYS) -> DataFrame:
    """Near when any polygon lies within the distance; no union of buffers is built."""
    near = spatial_join(points, polygons, [], "left_semi", within, tile, keys)
    far = spatial_join(points, polygons, [], "left_anti", within, tile, keys)
    return near.withColumn("side", F.lit("near")).unionByName(far.withColumn("side", F.lit("far")))


def catchment(stops: DataFrame, boundaries: DataFrame, buffer_m: float, keys=KEYS) -> DataFrame:
    """Stops inside the boundary or within its buffer, tagged."""
    edge = boundaries.select(*keys, geo.edges("rings").alias("_b"))
    left, edge, on = spread_hot_keys(stops, edge, list(keys))
    return (left.join(edge, on).drop("_salt")
            .withColumn("_in", geo.contains("_b", "x", "y"))
            .where(F.col("_in") | (geo.distance_to_edges("_b", "x", "y") <= buffer_m))
            .withColumn("catchment", F.when(F.col("_in"), "inside").otherwise("buffer"))
            .drop("_b", "_in"))


def box_overlap(a: DataFrame, b: DataFrame, a_id: str, b_id: str, max_span: float = 3.0,
                tile: float = 1.0) -> DataFrame:
    """Overlapping boxes of two tables; boxes of a that span too far are skipped.

    Both sides are tiled; a pair is reported only in the tile of its lower-left common corner,
    so no distinct is needed.
    """
    box = lambda: F.struct("xmin", "ymin", "xmax", "ymax")
    narrow = a.where((F.col("xmax") - F.col("xmin") <= max_span)
                     & (F.col("ymax") - F.col("ymin") <= max_span))
    left = narrow.select(a_id, box().alias("_a"), F.explode(tiles_of_box(box(), tile)).alias("_t"))
    right = b.select(b_id, box().alias("_b"), F.explode(tiles_of_box(box(), tile)).alias("_t"))
    pair = left.join(right, "_t")
    meet = ((F.col("_a.xmin") <= F.col("_b.xmax")) & (F.col("_b.xmin") <= F.col("_a.xmax"))
            & (F.col("_a.ymin") <= F.col("_b.ymax")) & (F.col("_b.ymin") <= F.col("_a.ymax")))
    corner = lambda axis: F.floor(F.greatest(F.col(f"_a.{axis}min"), F.col(f"_b.{axis}min"))
                                  / tile).cast("long")
    return pair.where(meet & (F.col("_t.tx") == corner("x")) & (F.col("_t.ty") == corner("y"))
                      ).select(a_id, b_id)


def dominant_zone(pairs: DataFrame, zone: str, keys=KEYS) -> DataFrame:
    """Keep the pairs of the zone most common per district; ties take the smaller zone."""
    counts = pairs.groupBy(*keys, zone).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min_by(zone, F.struct(-F.col("n"), zone)).alias(zone))
    return pairs.join(best, [*keys, zone], "left_semi")


def enclosing_region(points: DataFrame, levels: list[tuple[str, DataFrame, str]], point_id: str,
                     tile: float = 250.0, keys=KEYS) -> DataFrame:
    """The first level whose region contains the point; each level is (kind, polygons, id)."""
    out = points.select(*keys, point_id, "x", "y")
    for kind, polygons, rid in levels:
        hit = spatial_join(points.select(*keys, point_id, "x", "y"), polygons, [rid], tile=tile,
                           keys=keys).groupBy(*keys, point_id).agg(F.min(rid).alias(f"_{kind}"))
        out = out.join(hit, [*keys, point_id], "left")
    region = F.coalesce(*[F.col(f"_{kind}").cast("string") for kind, _, _ in levels])
    kind = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), k) for k, _, _ in levels])
    return out.select(*keys, point_id, kind.alias("kind"), region.alias("region"))


def representative_point(rings) -> Column:
    """A point inside the outer ring: the middle of the widest chord at mid height."""
    def widest(mid):
        xs = F.array_sort(F.transform(
            F.filter(geo.edges(rings), lambda s: (s["y1"] > mid) != (s["y2"] > mid)),
            lambda s: (s["x2"] - s["x1"]) * (mid - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]))
        spans = lambda v: F.array_max(F.transform(
            F.sequence(F.lit(0), F.size(v) - 2, F.lit(2)), lambda i: F.struct(
                (F.get(v, i + 1) - F.get(v, i)).alias("w"),
                ((F.get(v, i + 1) + F.get(v, i)) / 2.0).alias("x"))))
        return F.struct(geo.let(xs, spans)["x"].alias("x"), mid.alias("y"))

    return geo.let(geo.let(geo.bbox(rings), lambda b: (b["ymin"] + b["ymax"]) / 2.0), widest)


def residential_provenance(buildings: DataFrame, residential: DataFrame, building_id: str,
                           attribute: str, keys=KEYS) -> DataFrame:
    """Own attribute, then a residential footprint, then a residential land use."""
    from townloom.functions.classify import attribute_is_residential

    pts = buildings.withColumn("_p", representative_point("rings")).select(
        *keys, building_id, attribute, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    hits = (spatial_join(pts, residential, ["res_kind"], keys=keys)
            .groupBy(*keys, building_id)
            .agg(F.max((F.col("res_kind") == "building").cast("int")).alias("_b"),
                 F.max((F.col("res_kind") == "landuse").cast("int")).alias("_l")))
    via = (F.when(attribute_is_residential(attribute), "building_tag")
           .when(F.col("_b") == 1, "osm_building").when(F.col("_l") == 1, "osm_landuse")
           .otherwise("none"))
    return (pts.join(hits, [*keys, building_id], "left").withColumn("residential_via", via)
            .withColumn("is_residential", (F.col("residential_via") != "none").cast("int"))
            .select(*keys, building_id, "is_residential", "residential_via"))


def corridors(anchors: DataFrame, places: DataFrame, anchor_id: str, width: float = 50.0,
              halo: float = 25.0, keys=KEYS) -> DataFrame:
    """Places in the flat-capped corridor between two anchors, outside both halos.

    The corridor is a rectangle, so places meet it through the tile join.
    """
    a = anchors.select(*keys, F.col(anchor_id).alias("a_id"), F.col("cx").alias("ax"),
                       F.col("cy").alias("ay"), F.col("edges").alias("ae"))
    b = anchors.select(*keys, F.col(anchor_id).alias("b_id"), F.col("cx").alias("bx"),
                       F.col("cy").alias("by"), F.col("edges").alias("be"))
    pairs = a.join(b, list(keys)).where("a_id < b_id").withColumn(
        "length_m", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2))
    ux = (F.col("bx") - F.col("ax")) / F.col("length_m") * width
    uy = (F.col("by") - F.col("ay")) / F.col("length_m") * width
    corner = lambda px, py, side: (F.col(px) - side * uy, F.col(py) + side * ux)
    start = corner("ax", "ay", 1)
    strip = geo.ring_from(start, corner("bx", "by", 1), corner("bx", "by", -1),
                          corner("ax", "ay", -1), start)
    pairs = pairs.where("length_m > 0").withColumn("rings", F.array(strip))
    hits = spatial_join(places.select(*keys, "x", "y", "program"), pairs,
                        ["a_id", "b_id", "length_m", "ae", "be"], keys=keys)
    hits = hits.where((geo.distance("ae", "x", "y") > halo) & (geo.distance("be", "x", "y") > halo))
    counts = hits.groupBy(*keys, "a_id", "b_id", "length_m", "program").agg(
        F.count("*").alias("n"))
    effective = F.greatest(F.lit(1.0), F.col("length_m") - 2 * halo)
    return (counts.groupBy(*keys, "a_id", "b_id", "length_m")
            .agg(F.sum("n").alias("poi_count"),
                 F.min_by("program", F.struct(-F.col("n"), "program")).alias("dominant_program"))
            .withColumn("corridor_length_m", effective)
            .withColumn("density_per_100m", F.col("poi_count") / F.col("corridor_length_m") * 100)
            .drop("length_m"))


def distance_rings(anchors: DataFrame, places: DataFrame, anchor_id: str,
                   outer=(50.0, 100.0, 150.0, 200.0), keys=KEYS) -> DataFrame:
    """Dominant program per distance ring around each anchor."""
    near = spatial_join(places, anchors, [anchor_id], within=max(outer), keys=keys,
                        distance_as="edge_m").where("edge_m > 0")
    ring = F.lit(None).cast("int")
    for i in range(len(outer) - 1, -1, -1):
        ring = F.when(F.col("edge_m") <= outer[i], i).otherwise(ring)
    counts = near.withColumn("ring", ring).groupBy(*keys, anchor_id, "ring", "program").agg(
        F.count("*").alias("n"))
    return counts.groupBy(*keys, anchor_id, "ring").agg(
        F.min_by("program", F.struct(-F.col("n"), "program")).alias("dominant_program"),
        F.sum("n").alias("n_places"), F.max("n").alias("n_dominant"))


def match_by_name(labels: DataFrame, districts: DataFrame, label_name: str, district_name: str,
                  label_city: str | None = None, keys=KEYS) -> DataFrame:
    """Label to district by name: equal core names, then a shared word, then one core name inside the other.

    At each step a label needs a single district; among several the only one whose name holds the label's city
    is taken (for equal core names, failing that, the smallest). Districts are indexed by word and by every
    part of their core name; an index row holds the number of districts and one of them, so a word that
    many districts share is one row and no pair of label and district is formed before it is known to be single.
    """
    from townloom.functions.num import core_name

    letters = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")
    words = lambda c: F.filter(F.split(F.lower(F.col(c)), "[^a-z0-9]+"), lambda w: w != "")
    steps = lambda lo, hi: F.sequence(F.lit(lo) if isinstance(lo, int) else lo, hi)

    def parts(c):
        """All parts of a text, each once."""
        return F.array_distinct(F.flatten(F.transform(steps(1, F.length(c)), lambda i: F.transform(
            steps(1, F.length(c) - i + 1), lambda n: F.substr(c, i, n)))))

    def runs(w):
        """Neighbouring words written as one, as city names are compared."""
        return F.array_distinct(F.flatten(F.transform(steps(1, F.greatest(F.size(w), F.lit(1))), lambda i: F.transform(
            steps(1, F.greatest(F.size(w) - i + 1, F.lit(1))), lambda n: F.array_join(F.slice(w, i, n), "")))))

    city = letters(label_city) if label_city else F.lit("")
    lab = labels.select("label_id", core_name(label_name).alias("core"), F.array_distinct(words(label_name)).alias("words"),
                        F.coalesce(city, F.lit("")).alias("city"))
    dis = districts.select(F.struct(*keys).alias("d"), core_name(district_name).alias("core"),
                           F.array_distinct(words(district_name)).alias("words"), runs(words(district_name)).alias("runs"))
    asked = lambda column: lab.select(column.alias("key"), "label_id", "city").where("key <> ''")
    known = lambda column: dis.select(column.alias("key"), "d", "runs").where("key <> ''")
    # (step, labels by key, districts by key); a part of a name is only indexed if a label asks for it
    cores = asked(F.col("core"))
    ways = [(1, cores, known(F.col("core"))), (2, asked(F.explode("words")), known(F.explode("words"))),
            (3, cores, known(F.explode(parts(F.col("core")))).join(cores.select("key").distinct(), "key", "left_semi")),
            (3, asked(F.explode(parts(F.col("core")))), known(F.col("core")))]
    hits = None
    for step, ask, rows in ways:
        single = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("d"))
        local = rows.select("key", "d", F.explode("runs").alias("city")).groupBy("key", "city").agg(
            F.count("*").alias("n"), F.min("d").alias("d"))
        for by_city, index in ((False, single), (True, local)):
            found = ask.join(index, ["key", "city"] if by_city else ["key"]).select(
                "label_id", F.lit(step).alias("step"), F.lit(by_city).alias("by_city"), "n", "d")
            hits = found if hits is None else hits.unionByName(found)
    # an equal core name is found again as a part of itself, by both ways; that step counts districts, not hits
    one = hits.groupBy("label_id", "step", "by_city").agg(F.max("n").alias("n"), F.min("d").alias("d"), F.max("d").alias("d2"))
    one = one.withColumn("single", (F.col("n") == 1) & (F.col("d") == F.col("d2")))
    ranked = F.struct("step", (~F.col("single")).alias("_s"), "by_city")
    best = one.where("single OR step = 1 AND NOT by_city").groupBy("label_id").agg(F.min_by(
        F.struct("d", "step", F.col("by_city")), ranked).alias("b"))
    return best.select("label_id", *[F.col(f"b.d.{k}").alias(k) for k in keys],
                       F.element_at(F.array(F.lit("exact"), F.lit("token"), F.lit("substring")), F.col("b.step")).alias("matched_by"),
                       F.col("b.by_city").alias("by_city"))


def footprint_pairs(a: DataFrame, a_id: str, window: float, tile: float = 250.0,
                    keys=KEYS, force_rows: int | None = None) -> DataFrame:
    """Ordered pairs (a, b) where the box of b meets the square window around the centre of a, without outlines.

    Tiles that hold too many centres are split; `force_rows` does so beyond that many.
    """
    win = F.struct((F.col("cx") - window).alias("xmin"), (F.col("cy") - window).alias("ymin"),
                   (F.col("cx") + window).alias("xmax"), (F.col("cy") + window).alias("ymax"))
    place = lambda box: F.explode(tiles_of_box(box, tile)).alias("_t")
    left = a.select(*keys, F.col(a_id).alias("a_id"), "cx", "cy", win.alias("aw"), place(win))
    box = geo.bbox("rings")
    right = a.select(*keys, F.col(a_id).alias("b_id"), F.col("cx").alias("bx"), F.col("cy").alias("by"),
                     box.alias("bb"), place(box))
    flat = lambda d: d.withColumn("_tx", F.col("_t.tx")).withColumn("_ty", F.col("_t.ty"))
    left, right, on = spread_hot_keys(flat(left), flat(right).drop("_t"), [*keys, "_tx", "_ty"], force_rows)
    corner = lambda ax: F.floor(F.greatest(F.col(f"aw.{ax}min"), F.col(f"bb.{ax}min"))
                                / tile).cast("long")
    meet = ((F.col("aw.xmin") <= F.col("bb.xmax")) & (F.col("bb.xmin") <= F.col("aw.xmax"))
            & (F.col("aw.ymin") <= F.col("bb.ymax")) & (F.col("bb.ymin") <= F.col("aw.ymax")))
    return left.join(right, on).where(
        (F.col("a_id") != F.col("b_id")) & meet & (F.col("_t.tx") == corner("x"))
        & (F.col("_t.ty") == corner("y"))).drop("_t", "_tx", "_ty", "_salt", "aw", "bb")


def with_gaps(pairs: DataFrame, a: DataFrame, a_id: str, name: str, keys=KEYS) -> DataFrame:
    """Pairs (src, dst) with the distance of their outlines; outlines join only the pairs that are left."""
    from townloom.functions.shapes import outline_gap

    outline = lambda i, e: a.select(*keys, F.col(a_id).alias(i), F.col("edges").alias(e))
    met = pairs.join(outline("src", "_se"), [*keys, "src"]).join(outline("dst", "_de"), [*keys, "dst"])
    return met.withColumn(name, outline_gap("_se", "_de")).drop("_se", "_de")


def spatial_context(buildings: DataFrame, building_id: str = "building_id", radius: float = 50.0,
                    keys=KEYS) -> DataFrame:
    """Gap to the nearest footprint and number of footprints within the radius."""
    pairs = footprint_pairs(buildings, building_id, radius * 2, keys=keys)
    # a gap is the same both ways, so it is measured once; a footprint counts those that its own window meets
    ahead = F.col("a_id") < F.col("b_id")
    once = pairs.groupBy(*keys, F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst")).agg(
        F.max(F.when(ahead, F.col("a_id"))).alias("_s"), F.max(F.when(~ahead, F.col("a_id"))).alias("_d"))
    sides = F.explode(F.array_compact(F.array("_s", "_d"))).alias(building_id)
    found = with_gaps(once, buildings, building_id, "gap", keys).select(*keys, sides, "gap").groupBy(*keys, building_id).agg(
        F.min("gap").alias("nearest_neighbor_m"),
        F.count(F.when(F.col("gap") <= radius, 1)).alias("neighbors_within"))
    return (buildings.select(*keys, building_id).join(found, [*keys, building_id], "left")
            .fillna(0, ["neighbors_within"]))


def boundary_revision(old: DataFrame, new: DataFrame, canvas: DataFrame, size: float = 10.0,
                      keys=KEYS) -> DataFrame:
    """Identical / light (fits the canvas) / heavy, with the changed share of cells."""
    a = cell_cover(old, size, [*keys]).withColumn("_a", F.lit(1))
    b = cell_cover(new, size, [*keys]).withColumn("_b", F.lit(1))
    cells = a.join(b, [*keys, "cell_x", "cell_y"], "full").groupBy(*keys).agg(
        F.count("_a").alias("old_cells"), F.count("_b").alias("new_cells"),
        F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("changed"))
    box = geo.bbox("rings")
    fits = (new.select(*keys, box.alias("_n"), F.col("rings").alias("_new"))
            .join(canvas.select(*keys, geo.bbox("rings").alias("_c")), list(keys), "left")
            .join(old.select(*keys, F.col("rings").alias("_old")), list(keys), "left")
            .select(*keys, F.coalesce(
                (F.col("_n.xmin") >= F.col("_c.xmin")) & (F.col("_n.ymin") >= F.col("_c.ymin"))
                & (F.col("_n.xmax") <= F.col("_c.xmax")) & (F.col("_n.ymax") <= F.col("_c.ymax")),
                F.lit(False)).alias("_fits"), (F.col("_new") == F.col("_old")).alias("_same")))
    tier = (F.when(F.col("_same"), "identical").when(F.col("_fits") & (F.col("old_cells") > 0),
                                                     "light").otherwise("heavy"))
    return (fits.join(cells, list(keys), "left").select(
        *keys, tier.alias("tier"),
        F.round(100.0 * F.col("changed") / F.col("old_cells"), 1).alias("change_pct")))


def crop(features: DataFrame, boundaries: DataFrame, keys=KEYS) -> DataFrame:
    """Keep features with a vertex inside the boundary or a box around its centre."""
    b = boundaries.select(*keys, geo.edges("rings").alias("_b"), geo.bbox("rings").alias("_bb"))
    f = features.withColumn("_fb", geo.bbox("rings"))
    mx, my = (F.col("_bb.xmin") + F.col("_bb.xmax")) / 2, (F.col("_bb.ymin") + F.col("_bb.ymax")) / 2
    apart = ((F.col("_fb.xmax") < F.col("_bb.xmin")) | (F.col("_fb.xmin") > F.col("_bb.xmax"))
             | (F.col("_fb.ymax") < F.col("_bb.ymin")) | (F.col("_fb.ymin") > F.col("_bb.ymax")))
    vertex = F.exists(F.flatten("rings"), lambda p: geo.contains("_b", p["x"], p["y"]))
    around = (mx.between(F.col("_fb.xmin"), F.col("_fb.xmax"))
              & my.between(F.col("_fb.ymin"), F.col("_fb.ymax")))
    left, b, on = spread_hot_keys(f, b, list(keys))
    return left.join(b, on).where(~apart & (vertex | around)).select(*features.columns)
