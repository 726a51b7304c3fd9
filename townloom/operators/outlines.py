"""Outlines of cell sets as closed rings.

Every cell has four sides, walked with the cell on the left. Sides that two cells share cancel; each side
left is followed by one other, so the sides form cycles. Cycles are told apart and put in order by pointer
jumping: every side knows the side 1, 2, 4, 8, ... steps ahead, so the rounds grow with the logarithm of the
longest ring, whatever the number of rings and districts. A district of bounded size is traced by one task in
the same way, larger ones by joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.operators.spatial import KEYS
from townloom.session import by_size, columns_of
from townloom.session import cut_round as cut

MAX_DOUBLINGS = 64
TRACED_CELLS = 100_000  # cells of a district whose outline one task traces; larger ones go by joins
# direction: step to the cell across the side, start corner and end corner of the side, seen from the cell
SIDES = [(0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)]


def boundary_sides(cells: DataFrame, keys=KEYS) -> DataFrame:
    """(x, y, dir, to_x, to_y): the sides of cells that no other cell of the set shares, by their start corner."""
    k = list(keys)
    one = lambda s: F.struct(*(F.lit(v).alias(n) for n, v in zip(("dir", "i", "j", "sx", "sy", "ex", "ey"), s)))
    sides = cells.select(*k, "cell_x", "cell_y").distinct().withColumn("s", F.explode(F.array(*map(one, SIDES))))
    across = cells.select(*k, F.col("cell_x").alias("_x"), F.col("cell_y").alias("_y")).distinct()
    sides = sides.withColumn("_x", F.col("cell_x") + F.col("s.i")).withColumn("_y", F.col("cell_y") + F.col("s.j"))
    at = lambda c, side: (F.col(f"cell_{c}") + F.col(f"s.{side}{c}")).cast("long")
    return sides.join(across, [*k, "_x", "_y"], "left_anti").select(
        *k, at("x", "s").alias("x"), at("y", "s").alias("y"), F.col("s.dir").alias("dir"),
        at("x", "e").alias("to_x"), at("y", "e").alias("to_y"))


def followed(sides: DataFrame, keys=KEYS) -> DataFrame:
    """(x, y, dir, side, next): each side with the one that follows it.

    Where two cells touch at a corner only, two sides leave it; the one turning left belongs to the same cell.
    """
    k = list(keys)
    name = lambda x, y, d: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(d).alias("d"))
    leave = sides.select(*k, F.col("x").alias("to_x"), F.col("y").alias("to_y"), F.col("dir").alias("_d"))
    # left, straight on, right; a side never turns back
    turn = F.pmod(F.col("_d") - F.col("dir") + 4, F.lit(4))
    order = F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2)
    met = sides.join(leave, [*k, "to_x", "to_y"])
    return met.groupBy(*k, "x", "y", "dir").agg(F.min(F.struct(order.alias("o"), name("to_x", "to_y", "_d").alias("next"))).alias("_n")).select(
        *k, "x", "y", "dir", name("x", "y", "dir").alias("side"), F.col("_n.next").alias("next"))


def traced(cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sides of a set of cells as (x, y, dir), with the number of each one's first side and the steps from there."""
    xs, ys = (np.unique(np.concatenate([c - 1, c, c + 1])) for c in (cx, cy))
    at = lambda x, y: np.searchsorted(xs, x) * len(ys) + np.searchsorted(ys, y)
    cells = at(cx, cy)
    cells, first = np.unique(cells, return_index=True)
    cx, cy = cx[first], cy[first]
    start, end, way = [], [], []
    for d, i, j, sx, sy, ex, ey in SIDES:
        free = ~np.isin(at(cx + i, cy + j), cells)
        start.append(at(cx[free] + sx, cy[free] + sy))
        end.append(at(cx[free] + ex, cy[free] + ey))
        way.append(np.full(free.sum(), d))
    start, end, way = map(np.concatenate, (start, end, way))
    order = np.argsort(start * 4 + way)
    start, end, way = start[order], end[order], way[order]
    side, follow = start * 4 + way, np.full(len(start), -1)
    for turn in (3, 0, 1):  # right, straight on, left: the last that is there counts
        wanted = end * 4 + (way + turn) % 4
        found = np.minimum(np.searchsorted(side, wanted), len(side) - 1)
        follow = np.where(side[found] == wanted, found, follow)
    ahead, ring = follow, np.minimum(np.arange(len(side)), follow)
    while (ring[ahead] < ring).any():
        ring, ahead = np.minimum(ring, ring[ahead]), ahead[ahead]
    none = len(side)  # before a first side comes none
    before, steps = np.full(none + 1, none), np.zeros(none + 1, np.int64)
    later = follow != ring
    before[follow[later]], steps[follow[later]] = np.flatnonzero(later), 1
    while (before < none).any():
        steps, before = steps + steps[before], before[before]
    return xs[start // len(ys)], ys[start % len(ys)], way, ring, steps[:none]


def outline_corners(cells: DataFrame, cell: float, keys=KEYS, limit: int = TRACED_CELLS) -> DataFrame:
    """(ring, position, x, y): the corners of the rings in metres, outer rings counter-clockwise, holes clockwise.

    A ring is named by its smallest side; positions count sides from there and skip those that go straight on.
    A district of at most `limit` cells is traced by one task.
    """
    k = list(keys)
    cells = cut(cells.select(*k, F.col("cell_x").cast("long").alias("cell_x"), F.col("cell_y").cast("long").alias("cell_y")).dropna())
    small, large = by_size(cells, k, limit)

    def trace(key, pdf):
        x, y, way, ring, steps = traced(pdf["cell_x"].to_numpy(), pdf["cell_y"].to_numpy())
        last = np.lexsort((steps, ring))
        came = np.empty(len(way), way.dtype)  # the direction of the side before; a ring's last one is before its first
        came[last[1:]] = way[last[:-1]]
        heads = np.flatnonzero(np.diff(ring[last], prepend=-1))
        came[last[heads]] = way[last[np.append(heads[1:], len(last)) - 1]]
        c = np.flatnonzero(came != way)
        return pd.DataFrame({**dict(zip(k, key)), "rx": x[ring[c]], "ry": y[ring[c]], "rd": way[ring[c]], "position": steps[c],
                             "x": x[c] * cell, "y": y[c] * cell}, columns=[*k, "rx", "ry", "rd", "position", "x", "y"])

    out = small.groupBy(*k).applyInPandas(trace, columns_of(cells, k) + ", rx bigint, ry bigint, rd int, position bigint, x double, y double")
    out = out.select(*k, F.struct(F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rd").alias("d")).alias("ring"), "position", "x", "y")
    return out if large is None else out.unionByName(_corners_by_joins(cut(large), cell, k))


def _corners_by_joins(cells: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """outline_corners by rounds over all districts."""
    k = list(keys)
    sides = cut(followed(boundary_sides(cells, keys), keys))
    jump = cut(sides.select(*k, "side", F.col("next").alias("ahead"), F.least("side", "next").alias("ring")))
    for _ in range(MAX_DOUBLINGS):
        other = jump.select(*k, F.col("side").alias("ahead"), F.col("ahead").alias("_ahead"), F.col("ring").alias("_ring"))
        step = cut(jump.join(other, [*k, "ahead"]).select(
            *k, "side", F.col("_ahead").alias("ahead"), F.least("ring", "_ring").alias("ring"), (F.col("_ring") < F.col("ring")).alias("_new")))
        jump = step.drop("_new")
        # once no window of sides grows by a smaller one, each has gone all the way round
        if step.where("_new").isEmpty():
            break
    else:
        raise RuntimeError("rings did not close")
    rings = cut(sides.join(jump.select(*k, "side", "ring"), [*k, "side"]))
    # steps from the first side: its own predecessor pointer is cut, the others are followed back
    back = rings.select(*k, F.col("next").alias("side"), F.when(F.col("next") != F.col("ring"), F.col("side")).alias("before"),
                        F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("position"))
    back = cut(back)
    for _ in range(MAX_DOUBLINGS):
        if back.where("before IS NOT NULL").isEmpty():
            break
        other = back.select(*k, F.col("side").alias("before"), F.col("before").alias("_before"), F.col("position").alias("_more"))
        back = cut(back.join(other, [*k, "before"], "left").select(
            *k, "side", F.col("_before").alias("before"), (F.col("position") + F.coalesce("_more", F.lit(0))).alias("position")))
    placed = rings.join(back.select(*k, "side", "position"), [*k, "side"])
    into = rings.select(*k, F.col("next").alias("side"), F.col("dir").alias("_from"))
    corner = placed.join(into, [*k, "side"]).where("_from <> dir")
    return corner.select(*k, "ring", "position", (F.col("x") * cell).alias("x"), (F.col("y") * cell).alias("y"))


def outline_rings(corners: DataFrame, keys=KEYS) -> DataFrame:
    """(ring_no, is_hole, area_m2, perimeter_m, corners, ring): closed rings; holes have a negative area."""
    from townloom.functions import geo

    k = list(keys)
    r = corners.groupBy(*k, "ring").agg(F.array_sort(F.collect_list(F.struct("position", "x", "y"))).alias("_c"))
    points = F.transform("_c", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    r = r.select(*k, "ring", F.concat(points, F.slice(points, 1, 1)).alias("_r"), F.size("_c").cast("long").alias("corners"))
    edges = r.withColumn("_e", geo.segments("_r"))
    area = F.aggregate("_e", F.lit(0.0), lambda s, e: s + (e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2)
    length = F.aggregate("_e", F.lit(0.0), lambda s, e: s + F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"]))
    order = Window.partitionBy(*k).orderBy("ring")
    return edges.select(*k, F.row_number().over(order).alias("ring_no"), (area < 0).alias("is_hole"), area.alias("area_m2"),
                        length.alias("perimeter_m"), "corners", F.col("_r").alias("ring"))


def isochrone_outline(reached_xy: DataFrame, cell: float = 20.0, reach_m: float = 60.0, keys=KEYS) -> DataFrame:
    """The outline of the cells within reach of a reached node."""
    from townloom.operators.graph import isochrone_cells

    return outline_rings(outline_corners(isochrone_cells(reached_xy, cell, reach_m, keys), cell, keys), keys)
