"""Greedy de-duplication of same-named points, exact and distributed.

A point is kept when no kept earlier point of the same name lies within the distance, so its fate can hang
on a long chain of others. A round cuts the plane into tiles and follows all chains inside a tile at once;
only points that wait for an open point of another tile stay open. Tiles double from round to round as long
as none holds too many points, so rounds grow with the logarithm of a chain's length up to what a task
holds, then with the number of such tiles a chain crosses. A tile with more points is not gathered: of it, the earliest
open point of each small cell is looked at, and the next round goes back to smaller tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.session import cut_round as cut
from townloom.session import followed

MAX_ROUNDS = 10_000
TILE_POINTS = 20_000  # open points that one task follows together
FIRST_TILE, TILE_SIZES = 64, 24  # distances across the smallest tile, and how often tiles double


def greedy_dedup(points: DataFrame, order: str, name: str, distance: float, keys=("district_id",),
                 tile_points: int = TILE_POINTS, rounds: list | None = None) -> DataFrame:
    """Rows kept, in the declared order; rows without a name are always kept.

    `rounds` receives the number of open points after each round.
    """
    k = [*keys, "_name"]
    clean = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    named = points.withColumn("_name", clean).where("_name <> ''")
    # exact copies: only the first can be kept
    spots = named.groupBy(*k, "x", "y").agg(F.min(order).alias("_id"))
    size = distance / 1.4143  # a cell can keep only one point
    open_ = cut(spots.withColumn("_cx", geo.cell_of("x", size)).withColumn("_cy", geo.cell_of("y", size)))
    kept, level, highest = [], 0, TILE_SIZES
    for nth in range(MAX_ROUNDS):
        left = open_.count()
        if rounds is not None and nth:
            rounds.append(left)
        if not left:
            break
        edge = distance * FIRST_TILE * 2 ** level
        tile = lambda v: geo.cell_of(v, edge)
        tiled = open_.withColumn("_tx", tile("x")).withColumn("_ty", tile("y"))
        full = tiled.groupBy(*k, "_tx", "_ty").agg(F.count("*").alias("_n")).where(F.col("_n") > tile_points)
        full = cut(full.drop("_n"))
        crowded = not full.isEmpty()
        sure = _followed(tiled.join(full, [*k, "_tx", "_ty"], "left_anti") if crowded else tiled, tiled, k, edge, distance)
        if crowded:
            sure = sure.unionByName(_first_of_cells(tiled.join(full, [*k, "_tx", "_ty"], "left_semi"), open_, k, distance))
        sure = cut(sure)
        kept.append(sure.select(*keys, "_fid"))
        if len(kept) >= 16:
            kept = [cut(_union(kept))]
        near = ((F.col("x") - F.col("_fx")) ** 2 + (F.col("y") - F.col("_fy")) ** 2) <= distance * distance
        gone = _around(sure, k).join(open_, [*k, "_cx", "_cy"]).where(near).select(*keys, "_id").distinct()
        open_ = cut(open_.join(gone, [*keys, "_id"], "left_anti"))
        highest = max(level - 1, 0) if crowded else highest
        level = min(level + 1, highest)
    else:
        raise RuntimeError(f"points are still open after {MAX_ROUNDS} rounds")
    unnamed = points.where(clean == "")
    if not kept:
        return unnamed
    ids = _union(kept).select(*keys, F.col("_fid").alias(order))
    return points.join(ids, [*keys, order], "left_semi").unionByName(unnamed)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _around(first: DataFrame, k: list[str]) -> DataFrame:
    """Points (_fid, _fx, _fy) copied to all cells that may hold a point near them."""
    steps = F.sequence(F.lit(-2), F.lit(2))
    ring = F.explode(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    return first.withColumn("_o", ring).select(
        *k, (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"), "_fid", "_fx", "_fy")


def _first_of_cells(points: DataFrame, open_: DataFrame, k: list[str], distance: float) -> DataFrame:
    """The earliest points of their cells that have no earlier open point near them."""
    first = points.groupBy(*k, "_cx", "_cy").agg(F.min_by(F.struct("_id", "x", "y"), "_id").alias("_f")).select(
        *k, "_cx", "_cy", F.col("_f._id").alias("_fid"), F.col("_f.x").alias("_fx"), F.col("_f.y").alias("_fy"))
    near = ((F.col("x") - F.col("_fx")) ** 2 + (F.col("y") - F.col("_fy")) ** 2) <= distance * distance
    wait = _around(first, k).join(open_, [*k, "_cx", "_cy"]).where(near & (F.col("_id") < F.col("_fid"))).select(
        *k, "_fid").distinct()
    return first.join(wait, [*k, "_fid"], "left_anti")


def _followed(mine: DataFrame, every: DataFrame, k: list[str], edge: float, distance: float) -> DataFrame:
    """The points of the tiles of `mine` that are kept for sure; open points close to a tile come along."""
    span = lambda v: F.sequence(geo.cell_of(F.col(v) - distance, edge), geo.cell_of(F.col(v) + distance, edge))
    sent = every.select(*k, "_id", "x", "y", "_cx", "_cy", F.col("_tx").alias("_hx"), F.col("_ty").alias("_hy"),
                        F.explode(span("x")).alias("_tx"))
    sent = sent.select(*k, "_id", "x", "y", "_cx", "_cy", "_hx", "_hy", "_tx", F.explode(span("y")).alias("_ty"))
    own = (F.col("_hx") == F.col("_tx")) & (F.col("_hy") == F.col("_ty"))
    tiles = mine.select(*k, "_tx", "_ty").distinct()
    sent = sent.join(tiles, [*k, "_tx", "_ty"], "left_semi").withColumn("_own", own).drop("_hx", "_hy")

    def follow(of):
        by = np.argsort(of["_id"], kind="stable")
        x, y, own = of["x"][by].astype(float).tolist(), of["y"][by].astype(float).tolist(), of["_own"][by].tolist()
        cx, cy = of["_cx"][by].tolist(), of["_cy"][by].tolist()
        cells, sure = {}, np.zeros(len(by), bool)
        for i in range(len(by)):  # earlier points are decided or open for this round
            waits, hit = not own[i], False
            for a in range(cx[i] - 2, cx[i] + 3):
                for b in range(cy[i] - 2, cy[i] + 3):
                    for j in cells.get((a, b), ()):
                        if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= distance * distance:
                            hit, waits = hit or sure[j], waits or not sure[j]
                if hit:
                    break
            if hit:
                continue  # removed: it holds back nothing
            sure[i] = not waits
            cells.setdefault((cx[i], cy[i]), []).append(i)
        out = by[sure]
        return {"_cx": of["_cx"][out], "_cy": of["_cy"][out], "_fid": of["_id"][out], "_fx": of["x"][out], "_fy": of["y"][out]}

    return followed(sent, [*k, "_tx", "_ty"], follow, _cx="_cx", _cy="_cy", _fid="_id", _fx="double", _fy="double").drop("_tx", "_ty")
