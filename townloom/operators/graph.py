"""Graphs as edge tables: components, street graphs, shortest paths and betweenness (R)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from townloom.functions import geo
from townloom.operators.spatial import KEYS, footprint_pairs, with_gaps
from townloom.session import by_size, columns_of, followed
from townloom.session import cut_round as cut

MAX_ROUNDS = 100_000
LINKED_ROWS = 100_000  # links and nodes of a district whose components one task follows; larger ones go by joins
ROUTED_ROWS = 1024  # links and sources of a district whose paths one task follows; larger ones go by joins
PLAIN_IDS = ("tinyint", "smallint", "int", "bigint", "string")


def both_ways(edges: DataFrame, keys, extra=()) -> DataFrame:
    return edges.select(*keys, "src", "dst", *extra).unionByName(
        edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), *extra))


def lowest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest number reachable from every number below n over the links a - b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, low[a], low[b])
        np.minimum.at(new, low[b], low[a])
        while (new[new] < new).any():
            new = new[new]
        if (new == low).all():
            return low
        low = new


def connected_components(nodes: DataFrame, edges: DataFrame, keys=KEYS, limit: int = LINKED_ROWS) -> DataFrame:
    """Smallest reachable node id as the component of every node.

    A district of at most `limit` distinct nodes and links is followed by one task, larger ones by rounds of joins.
    """
    k = list(keys)
    ids = nodes.schema["node"].dataType
    plain = ids.simpleString() in PLAIN_IDS and all(edges.schema[c].dataType == ids for c in ("src", "dst"))
    if not plain or not k:
        return _components_by_joins(nodes, edges, k)
    # a node is a link to itself
    rows = nodes.select(*k, F.col("node").alias("src"), F.col("node").alias("dst")).unionByName(
        edges.select(*k, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst"))
    rows = cut(rows.dropna().distinct())
    small, large = by_size(rows, k, limit)

    def follow(key, pdf):
        ids, at = np.unique(pdf[["src", "dst"]].to_numpy().ravel(), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        known = np.zeros(len(ids), bool)
        known[a[a == b]] = True
        link = known[a] & known[b]
        low = lowest_reachable(a[link], b[link], len(ids))
        return pd.DataFrame({**dict(zip(k, key)), "node": ids[known], "component": ids[low[known]]}, columns=[*k, "node", "component"])

    out = small.groupBy(*k).applyInPandas(follow, columns_of(nodes, k, node="node", component="node"))
    if large is not None:
        large = cut(large)
        out = out.unionByName(_components_by_joins(large.where("src = dst").select(*k, F.col("src").alias("node")), large.where("src <> dst"), k))
    return cut(out)


def _components_by_joins(nodes: DataFrame, edges: DataFrame, k: list[str]) -> DataFrame:
    """connected_components by rounds over all districts.

    Every node points to a parent with a smaller id. In a round, nodes and their parents move to
    the smallest grandparent seen over an edge, then follow their grandparent (the FastSV scheme),
    so trees merge and flatten together and the number of rounds grows with the logarithm.
    """
    links = cut(both_ways(edges, k).distinct())
    tree = cut(nodes.select(*k, "node").distinct().withColumn("f", F.col("node"))
               .withColumn("g", F.col("node")))
    for _ in range(MAX_ROUNDS):
        seen = links.join(tree.select(*k, F.col("node").alias("dst"), F.col("g").alias("_g")),
                          [*k, "dst"]).groupBy(*k, F.col("src").alias("node")).agg(
            F.min("_g").alias("_m"))
        own = tree.join(seen, [*k, "node"])
        ask = own.select(*k, F.explode(F.array_distinct(F.array("node", "f"))).alias("node"), "_m")
        ask = ask.groupBy(*k, "node").agg(F.min("_m").alias("_m"))
        moved = cut(tree.join(ask, [*k, "node"], "left").select(
            *k, "node", F.col("g").alias("_old"), F.least("f", "g", "_m").alias("f")))
        up = moved.select(*k, F.col("node").alias("f"), F.col("f").alias("g"))
        nxt = cut(moved.join(up, [*k, "f"]).select(*k, "node", "f", "g", "_old"))
        if nxt.where("g <> _old").isEmpty():
            return nxt.select(*k, "node", F.col("g").alias("component"))
        tree = nxt.drop("_old")
    raise RuntimeError("components did not settle")


def component_summary(components: DataFrame, keys=KEYS) -> DataFrame:
    """Number of components, largest one, and the count of tiny ones."""
    size = components.groupBy(*keys, "component").agg(F.count("*").alias("_n"))
    return size.groupBy(*keys).agg(
        F.sum("_n").alias("nodes"), F.count("*").alias("components"),
        F.max("_n").alias("largest_component_nodes"),
        F.count(F.when(F.col("_n") <= 2, 1)).alias("orphan_components"))


def street_graph(lines: DataFrame, tolerance: float, keys=KEYS) -> DataFrame:
    """R2: edges between snapped line ends; loops are dropped, parallel edges stay.

    `lines` has edge_id, x1, y1, x2, y2 and length_m. Half-way coordinates snap to even.
    """
    snap = lambda c: F.bround(F.col(c) / tolerance, 0).cast("long")
    node = lambda x, y: F.concat_ws("_", snap(x), snap(y))
    e = lines.select(*keys, "edge_id", node("x1", "y1").alias("src"), node("x2", "y2").alias("dst"),
                     "length_m")
    return e.where("src <> dst")


def walk_graph(lines: DataFrame, grid: float = 0.5, keys=KEYS) -> DataFrame:
    """Every segment of every line as an undirected edge; parallels keep the shortest.

    `lines` has a `line` column of points.
    """
    snap = lambda v: F.bround(v / grid, 0) * grid
    seg = lines.select(*keys, F.explode(geo.segments("line")).alias("s")).select(
        *keys, snap(F.col("s.x1")).alias("ax"), snap(F.col("s.y1")).alias("ay"),
        snap(F.col("s.x2")).alias("bx"), snap(F.col("s.y2")).alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    name = lambda x, y: F.concat_ws("_", F.col(x).cast("string"), F.col(y).cast("string"))
    e = seg.select(*keys, name("ax", "ay").alias("_a"), name("bx", "by").alias("_b"),
                   F.sqrt(dx * dx + dy * dy).alias("w")).where("_a <> _b")
    return e.groupBy(*keys, F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")
                     ).agg(F.min("w").alias("length_m"))


def shortest_simple(edges: DataFrame, keys=KEYS) -> DataFrame:
    """Undirected simple graph with the shortest of parallel edges."""
    return edges.groupBy(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst")
                         .alias("dst")).agg(F.min("length_m").alias("length_m"))


def into(value: np.ndarray, to: np.ndarray, n: int, how) -> np.ndarray:
    """Columns of `value`, one an arc in ascending order of `to`, brought together by their end."""
    first = np.flatnonzero(np.diff(to, prepend=-1))
    out = np.full((len(value), n), np.inf if how is np.minimum else 0.0)
    if len(to):
        out[:, to[first]] = how.reduceat(value, first, axis=1)
    return out


def distances(sources: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Distances of all nodes from every source over arcs a -> b, in ascending order of b."""
    dist = np.full((len(sources), n), np.inf)
    dist[np.arange(len(sources)), sources] = 0.0
    while True:
        new = np.minimum(dist, into(dist[:, a] + length, b, n, np.minimum))
        if (new == dist).all():
            return dist
        dist = new


def shortest_paths(edges: DataFrame, sources: DataFrame, cutoff: float | None = None, keys=KEYS,
                   limit: int = ROUTED_ROWS) -> DataFrame:
    """Distance from each source node to the nodes within a budget.

    A district of at most `limit` simple edges and sources is followed by one task; in larger ones all advance together.
    """
    k = list(keys)
    simple = shortest_simple(edges, keys).dropna()
    sources = sources.select(*k, "node").dropna().distinct()
    ids = sources.schema["node"].dataType
    if ids.simpleString() not in PLAIN_IDS or any(simple.schema[c].dataType != ids for c in ("src", "dst")):
        return relaxed(cut(both_ways(simple, k, ["length_m"])), sources, cutoff, k)
    rows = cut(simple.select(*k, "src", "dst", "length_m").unionByName(sources.select(
        *k, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("length_m"))))
    small, large = by_size(rows, k, limit)
    most = np.inf if cutoff is None else cutoff

    def follow(of):
        ids, at = np.unique(np.concatenate([of["src"], of["dst"]]), return_inverse=True)
        a, b = at.reshape(2, -1)
        length = of["length_m"].astype(float)
        start = a[np.isnan(length)]
        to, fro, length = np.concatenate([b, a]), np.concatenate([a, b]), np.concatenate([length, length])
        order = np.lexsort((fro, to))
        order = order[~np.isnan(length[order])]
        d = distances(start, fro[order], to[order], length[order], len(ids))
        s, v = np.nonzero(np.isfinite(d) & ((d <= most) | (np.arange(len(ids)) == start[:, None])))
        return {"source": ids[start[s]], "node": ids[v], "dist": d[s, v]}

    out = followed(small, k, follow, source="src", node="src", dist="double")
    if large is not None:
        large = cut(large)
        links = cut(both_ways(large.where("length_m IS NOT NULL"), k, ["length_m"]))
        out = out.unionByName(relaxed(links, large.where("length_m IS NULL").select(*k, F.col("src").alias("node")), cutoff, k))
    return cut(out)


def relaxed(links: DataFrame, sources: DataFrame, cutoff: float | None, keys: list[str]) -> DataFrame:
    """Distances by rounds of relaxation over directed links: only nodes whose distance improved spread further."""
    k = [*keys, "source"]
    best = cut(sources.select(*keys, F.col("node").alias("source"), "node").withColumns(
        {"dist": F.lit(0.0), "_up": F.lit(True)}))
    for _ in range(MAX_ROUNDS):
        front = best.where("_up").drop("_up")
        reach = front.join(links.withColumnRenamed("src", "node"), [*keys, "node"]).select(
            *k, F.col("dst").alias("node"), (F.col("dist") + F.col("length_m")).alias("_d"))
        if cutoff is not None:
            reach = reach.where(F.col("_d") <= cutoff)
        reach = reach.groupBy(*k, "node").agg(F.min("_d").alias("_d"))
        best = cut(best.drop("_up").join(reach, [*k, "node"], "full").select(
            *k, "node", F.least("dist", "_d").alias("dist"),
            (F.col("_d").isNotNull() & (F.col("dist").isNull() | (F.col("_d") < F.col("dist"))))
            .alias("_up")))
        if best.where("_up").isEmpty():
            return best.drop("_up")
    raise RuntimeError("paths did not settle")


def nearest_node(nodes: DataFrame, points: DataFrame, keys=KEYS) -> DataFrame:
    """The network node closest to one point per district; ties take the smaller id."""
    p = points.select(*keys, F.col("x").alias("_px"), F.col("y").alias("_py"))
    d = (F.col("x") - F.col("_px")) ** 2 + (F.col("y") - F.col("_py")) ** 2
    return nodes.join(p, list(keys)).withColumn("_d", F.round(F.sqrt(d), 6)).groupBy(*keys).agg(
        F.min_by("node", F.struct("_d", "node")).alias("node"), F.min("_d").alias("snap_m"))


def walk_budgets(reached: DataFrame, minutes, metres_per_minute: float, keys=KEYS) -> DataFrame:
    """Nodes reached per time budget."""
    b = F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), F.lit(
        m * metres_per_minute).alias("budget_m")) for m in minutes])).alias("_b")
    return reached.select(*keys, "dist", b).where(F.col("dist") <= F.col("_b.budget_m")).groupBy(
        *keys, F.col("_b.minutes").alias("minutes"), F.col("_b.budget_m").alias("budget_m")).agg(
        F.count("*").alias("reachable_nodes"))


def isochrone_cells(reached_xy: DataFrame, cell: float = 20.0, reach_m: float = 60.0, keys=KEYS
                    ) -> DataFrame:
    """The cells whose centre is within 60 m of a reached node."""
    r = int(reach_m // cell) + 1
    ring = F.sequence(F.lit(-r), F.lit(r))
    c = reached_xy.select(*keys, "x", "y", geo.cell_of("x", cell).alias("_cx"),
                          geo.cell_of("y", cell).alias("_cy"))
    c = c.select(*keys, "x", "y", "_cy", F.explode(F.transform(ring, lambda i: F.col("_cx") + i))
                 .alias("cell_x")).select(*keys, "x", "y", "cell_x", F.explode(
                     F.transform(ring, lambda j: F.col("_cy") + j)).alias("cell_y"))
    dx = geo.cell_centre("cell_x", cell) - F.col("x")
    dy = geo.cell_centre("cell_y", cell) - F.col("y")
    return c.where(dx * dx + dy * dy <= reach_m * reach_m).select(*keys, "cell_x", "cell_y").distinct()


def isochrone_area(reached_xy: DataFrame, cell: float = 20.0, reach_m: float = 60.0, keys=KEYS
                   ) -> DataFrame:
    """Area of the cells within 60 m of a reached node."""
    near = isochrone_cells(reached_xy, cell, reach_m, keys)
    return near.groupBy(*keys).agg((F.count("*") * F.lit(cell * cell)).alias("area_m2"))


def adjacency_edges(buildings: DataFrame, method: str = "radius", k: int = 6, radius: float = 80.0,
                    prune: float | None = None, building_id: str = "building_id", keys=KEYS
                    ) -> DataFrame:
    """Footprint adjacency by radius or by nearest neighbours, both directions.

    knn looks at the window of the prune distance; an edge exists when either end chose it.
    """
    reach = radius if method == "radius" else (prune or 120.0)
    pairs = footprint_pairs(buildings, building_id, reach, keys=keys)
    cd = F.sqrt((F.col("cx") - F.col("bx")) ** 2 + (F.col("cy") - F.col("by")) ** 2)
    pairs = pairs.withColumn("centroid_m", cd).where(F.col("centroid_m") <= reach)
    if method == "knn":
        w = Window.partitionBy(*keys, "a_id").orderBy(F.round("centroid_m", 6), "b_id")
        pairs = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    one = pairs.groupBy(*keys, F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst")).agg(
        F.min("centroid_m").alias("centroid_m"))
    one = with_gaps(one, buildings, building_id, "gap_m", keys)
    return both_ways(one, list(keys), ["centroid_m", "gap_m"])


def assign_tiles(nodes: DataFrame, size: float, keys=KEYS) -> DataFrame:
    """Tile of each node, counted from the district's lower-left node."""
    low = nodes.groupBy(*keys).agg(F.min("cx").alias("_x0"), F.min("cy").alias("_y0"))
    t = lambda c, o: F.floor((F.col(c) - F.col(o)) / size).cast("long")
    return nodes.join(low, list(keys)).withColumn("tile", F.concat_ws(
        "_", t("cx", "_x0"), t("cy", "_y0"))).drop("_x0", "_y0")


def induced_subgraphs(tiled: DataFrame, edges: DataFrame, ident: str, min_nodes: int, keys=KEYS
                      ) -> DataFrame:
    """Edges with both ends in the same tile, tiles with enough nodes only."""
    size = tiled.groupBy(*keys, "tile").agg(F.count("*").alias("tile_nodes")).where(
        F.col("tile_nodes") >= min_nodes)
    n = tiled.select(*keys, F.col(ident).alias("_n"), "tile").join(size, [*keys, "tile"])
    a = n.withColumnRenamed("_n", "src")
    b = n.select(*keys, F.col("_n").alias("dst"), F.col("tile").alias("_t"))
    return edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where("tile = _t").drop("_t")


def graph_diagnostics(nodes: DataFrame, edges: DataFrame, ident: str, keys=KEYS) -> DataFrame:
    """Nodes, directed edges, mean and median degree, isolated nodes."""
    from townloom.operators.ranks import quantiles

    deg = edges.groupBy(*keys, F.col("src").alias(ident)).agg(F.count("*").alias("degree"))
    d = nodes.select(*keys, ident).join(deg, [*keys, ident], "left").fillna(0, ["degree"])
    a = d.groupBy(*keys).agg(F.count("*").alias("nodes"), F.sum("degree").alias("edges"),
                             F.avg("degree").alias("mean_degree"),
                             F.count(F.when(F.col("degree") == 0, 1)).alias("isolated"))
    return a.join(quantiles(d, list(keys), "degree", {"median_degree": 0.5}), list(keys))


# --- betweenness (R4) ---------------------------------------------------------------------------

BATCH_STATES = 50_000_000  # (source, node) states of a batch of sources, over all districts
UNION_PARTS = 16
ROUTED_STATES = 1 << 20  # (source, arc) states that a task holds at once


def largest_component_edges(simple: DataFrame, keys=KEYS) -> DataFrame:
    """The simple edges of each district's largest component (ties: smaller label)."""
    nodes = both_ways(simple, list(keys)).select(*keys, F.col("src").alias("node")).distinct()
    comp = connected_components(nodes, simple, keys)
    size = comp.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    top = size.groupBy(*keys).agg(F.min_by(F.struct("component", "n"), F.struct(
        -F.col("n"), "component")).alias("_t")).select(
        *keys, F.col("_t.component").alias("component"), F.col("_t.n").alias("n"))
    keep = comp.join(top, [*keys, "component"]).select(*keys, F.col("node").alias("src"), "n")
    return simple.join(keep, [*keys, "src"])


def settled_sums(base: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray, extra: float) -> np.ndarray:
    """topological_sums for rows of one source each: `share` is 0 off the source's arcs a -> b, in ascending order of b."""
    value = base
    while True:
        new = base + into(share * (extra + value[:, a]), b, base.shape[1], np.add)
        if (new == value).all():
            return value
        value = new


def flows(a: np.ndarray, b: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Flow over the edges a - b when each of n nodes sends one unit to every node, split evenly over shortest paths."""
    fro, to = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((fro, to))
    turned = np.lexsort((to, fro))  # the same arcs by their start
    total = np.zeros(2 * len(a))
    for source in np.array_split(np.arange(n), -(-n * len(order) // ROUTED_STATES)):
        dist = distances(source, fro[order], to[order], np.concatenate([length, length])[order], n)
        on = (np.abs(dist[:, fro] + np.concatenate([length, length]) - dist[:, to]) <= 1e-9) & (dist[:, to] > dist[:, fro])
        start = (np.arange(n) == source[:, None]).astype(float)
        paths = settled_sums(start, fro[order], to[order], on[:, order].astype(float), 0.0)
        share = np.where(on, paths[:, fro] / paths[:, to], 0.0)
        loads = settled_sums(np.zeros_like(start), to[turned], fro[turned], share[:, turned], 1.0)
        total += (share * (1 + loads[:, to])).sum(0)
    return total[:len(a)] + total[len(a):]


def edge_betweenness(edges: DataFrame, keys=KEYS, batch_states: int = BATCH_STATES, limit: int = ROUTED_ROWS) -> DataFrame:
    """Length-weighted edge betweenness of the largest component, normalised by node pairs.

    Returns src, dst, length_m, centrality per simple edge. A district of at most `limit` simple edges is followed by
    one task, larger ones by joins. Lengths are positive; paths that differ by less than 1e-9 count as equally short.
    """
    k = list(keys)
    simple = cut(shortest_simple(edges, keys).dropna())
    ids = simple.schema["src"].dataType
    if ids.simpleString() not in PLAIN_IDS or simple.schema["dst"].dataType != ids:
        return _betweenness_by_joins(simple, k, batch_states)
    small, large = by_size(simple, k, limit)

    def follow(of):
        ids, at = np.unique(np.concatenate([of["src"], of["dst"]]), return_inverse=True)
        a, b = at.reshape(2, -1)
        low = lowest_reachable(a, b, len(ids))
        size = np.bincount(low)
        mine = low[a] == size.argmax()  # the first of equal ones has the smaller label
        n = int(size.max())
        _, at = np.unique(np.concatenate([a[mine], b[mine]]), return_inverse=True)
        c, d = at.reshape(2, -1)
        length = of["length_m"][mine]
        return {"src": of["src"][mine], "dst": of["dst"][mine], "length_m": length,
                "centrality": flows(c, d, length.astype(float), n) / (float(n) * (n - 1))}

    out = followed(small, k, follow, src="src", dst="dst", length_m="length_m", centrality="double")
    if large is not None:
        out = out.unionByName(_betweenness_by_joins(cut(large), k, batch_states))
    return cut(out)


def _betweenness_by_joins(simple: DataFrame, k: list[str], batch_states: int) -> DataFrame:
    """edge_betweenness by rounds over all districts.

    Sources are dealt into batches whose (source, node) states are bounded; all districts advance together within a
    batch, and only the sums per edge are carried from batch to batch.
    """
    e = cut(largest_component_edges(simple, k))
    links = cut(both_ways(e, k, ["length_m"]))
    nodes = cut(links.select(*k, F.col("src").alias("node")).distinct())
    states = e.select(*k, "n").distinct().agg(F.sum(F.col("n") * F.col("n")).alias("s")).first().s
    batches = max(1, -(-int(states or 0) // batch_states))
    total = None
    for batch in range(batches):
        mine = nodes.where(F.pmod(F.xxhash64(*k, "node"), F.lit(batches)) == batch)
        part = _flows(links, mine, k)
        total = part if total is None else total.unionByName(part)
        total = cut(total.groupBy(*k, "src", "dst").agg(F.sum("score").alias("score")))
    n = F.col("n").cast("double")
    return e.join(total, [*k, "src", "dst"], "left").select(
        *k, "src", "dst", "length_m",
        (F.coalesce("score", F.lit(0.0)) / (n * (n - 1))).alias("centrality"))


def _flows(links: DataFrame, sources: DataFrame, k: list[str]) -> DataFrame:
    """Flow over every edge when each source sends one unit to every node, split evenly over shortest paths."""
    s = [*k, "source"]
    dist = relaxed(links, sources, None, k)
    a = dist.select(*s, F.col("node").alias("src"), F.col("dist").alias("_da"))
    b = dist.select(*s, F.col("node").alias("dst"), F.col("dist").alias("_db"))
    arcs = cut(links.join(a, [*k, "src"]).join(b, [*s, "dst"]).where(
        (F.abs(F.col("_da") + F.col("length_m") - F.col("_db")) <= 1e-9) & (F.col("_db") > F.col("_da"))
    ).select(*s, "src", "dst"))
    start = dist.select(*s, "node", F.when(F.col("node") == F.col("source"), 1.0).otherwise(0.0).alias("base"))
    paths = topological_sums(start, arcs.withColumn("share", F.lit(1.0)), s, 0.0)
    pa = paths.select(*s, F.col("node").alias("src"), F.col("value").alias("_pa"))
    pb = paths.select(*s, F.col("node").alias("dst"), F.col("value").alias("_pb"))
    share = cut(arcs.join(pa, [*s, "src"]).join(pb, [*s, "dst"]).select(
        *s, "src", "dst", (F.col("_pa") / F.col("_pb")).alias("share")))
    back = share.select(*s, F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    loads = topological_sums(start.withColumn("base", F.lit(0.0)), back, s, 1.0)
    flow = share.join(loads.withColumnRenamed("node", "dst"), [*s, "dst"])
    return flow.groupBy(*k, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
                        ).agg(F.sum(F.col("share") * (1 + F.col("value"))).alias("score"))


def topological_sums(nodes: DataFrame, arcs: DataFrame, s: list[str], extra: float) -> DataFrame:
    """value(v) = base(v) + sum over arcs u -> v of share * (extra + value(u)), on acyclic graphs.

    `nodes` has node and base, `arcs` src, dst and share. A node is settled, and sends on its value once,
    when all its arcs have come in, so every arc is joined once; settled nodes leave the waiting table.
    """
    need = arcs.groupBy(*s, F.col("dst").alias("node")).agg(F.count("*").alias("need"))
    waiting = cut(nodes.select(*s, "node", F.col("base").alias("value")).join(need, [*s, "node"], "left").select(
        *s, "node", "value", F.coalesce("need", F.lit(0)).alias("need")))
    done = []
    for _ in range(MAX_ROUNDS):
        front = waiting.where("need = 0").select(*s, "node", "value")
        if front.isEmpty():
            break
        done.append(front)
        sent = arcs.join(front.withColumnRenamed("node", "src"), [*s, "src"]).groupBy(*s, F.col("dst").alias("node")).agg(
            F.sum(F.col("share") * (F.lit(extra) + F.col("value"))).alias("_v"), F.count("*").alias("_n"))
        waiting = cut(waiting.where("need > 0").join(sent, [*s, "node"], "left").select(
            *s, "node", (F.col("value") + F.coalesce("_v", F.lit(0.0))).alias("value"),
            (F.col("need") - F.coalesce("_n", F.lit(0))).alias("need")))
        if len(done) >= UNION_PARTS:
            done = [cut(_all(done))]
    else:
        raise RuntimeError(f"sums have not settled after {MAX_ROUNDS} rounds")
    if not waiting.isEmpty():
        raise RuntimeError("the arcs hold a cycle")
    return cut(_all(done)) if done else waiting.drop("need")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def attach_centrality(edges: DataFrame, scores: DataFrame, ident: str = "edge_id", keys=KEYS
                      ) -> DataFrame:
    """Score per feature; parallel shortest edges share it, longer parallels get 0."""
    k = list(keys)
    e = edges.select(*k, ident, F.least("src", "dst").alias("src"), F.greatest("src", "dst")
                     .alias("dst"), "length_m")
    j = e.join(scores.select(*k, "src", "dst", F.col("length_m").alias("_m"), "centrality"),
               [*k, "src", "dst"], "left")
    short = F.coalesce(F.col("length_m") == F.col("_m"), F.lit(False))
    # parallels of an edge are where the join has brought them
    n = F.count(F.when(short, 1)).over(Window.partitionBy(*k, "src", "dst"))
    return j.withColumn("_n", n).groupBy(*k, ident).agg(F.avg(
        F.when(short, F.col("centrality") / F.col("_n")).otherwise(0.0)).alias("centrality"))


def centrality_summary(features: DataFrame, keys=KEYS) -> DataFrame:
    """Count, max, mean and mean of the non-zero values."""
    return features.groupBy(*keys).agg(
        F.count("*").alias("feature_count"), F.max("centrality").alias("max_centrality"),
        F.avg("centrality").alias("mean_centrality"),
        F.avg(F.when(F.col("centrality") > 0, F.col("centrality"))).alias("mean_centrality_nonzero"))
