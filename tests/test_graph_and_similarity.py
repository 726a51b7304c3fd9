import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from townloom.functions import vocab as V
from townloom.operators import clustering, graph, neighbours
from townloom.operators import similarity as sim
from townloom.operators.dedup import greedy_dedup


def edges(spark, rows):
    return spark.createDataFrame([(0, a, b, float(w)) for a, b, w in rows],
                                 "district_id int, src long, dst long, length_m double")


def test_components_against_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2)) if a != b]
    parent = list(range(400))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.range(400).select(F.lit(0).alias("district_id"), F.col("id").alias("node"))
    got = graph.connected_components(nodes, edges(spark, [(a, b, 1) for a, b in pairs]))
    assert {r.node: r.component for r in got.collect()} == {v: find(v) for v in range(400)}


def test_betweenness_closed_forms(spark):
    path = {(r.src, r.dst): r.centrality for r in graph.edge_betweenness(
        edges(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1)])).collect()}
    # edge i of a path of n nodes carries i(n-i) of n(n-1)/2 pairs
    assert path == pytest.approx({(1, 2): 3 / 6, (2, 3): 4 / 6, (3, 4): 3 / 6})
    star = graph.edge_betweenness(edges(spark, [(0, i, 1) for i in range(1, 6)])).collect()
    assert [r.centrality for r in star] == pytest.approx([5 / 15] * 5)


def test_betweenness_in_batches(spark):
    """Any number of batches gives the same; all flows add up to the edges on all shortest paths."""
    rng = np.random.default_rng(2)
    rows = {(int(min(a, b)), int(max(a, b))): float(w) for (a, b), w in zip(
        rng.integers(0, 12, (24, 2)), rng.integers(1, 4, 24)) if a != b}
    e = edges(spark, [(a, b, w) for (a, b), w in rows.items()])
    one = {(r.src, r.dst): r.centrality for r in graph.edge_betweenness(e).collect()}
    two = {(r.src, r.dst): r.centrality for r in graph.edge_betweenness(e, batch_states=30).collect()}
    assert one == pytest.approx(two)
    free = {k: w + float(x) for (k, w), x in zip(rows.items(), rng.random(len(rows)))}  # no two paths are equally long
    got = graph.edge_betweenness(edges(spark, [(a, b, w) for (a, b), w in free.items()])).collect()
    nodes = sorted({r.src for r in got} | {r.dst for r in got})
    hops = 0
    for s in nodes:
        best = {s: (0.0, 0)}
        for _ in nodes:
            for (a, b), w in free.items():
                for u, v in ((a, b), (b, a)):
                    if u in best and (v not in best or best[u][0] + w < best[v][0]):
                        best[v] = best[u][0] + w, best[u][1] + 1
        hops += sum(h for _, h in best.values())
    assert sum(r.centrality for r in got) * len(nodes) * (len(nodes) - 1) == pytest.approx(hops)


def test_sums_need_acyclic_arcs(spark):
    nodes = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.0)], "s int, node int, base double")
    arcs = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 1, 1.0)], "s int, src int, dst int, share double")
    with pytest.raises(RuntimeError):
        graph.topological_sums(nodes, arcs, ["s"], 0.0)


def test_parallel_edges_share_centrality(spark):
    e = spark.createDataFrame([(0, 1, 1, 2, 5.0), (0, 2, 1, 2, 5.0), (0, 3, 2, 1, 9.0), (0, 4, 7, 8, 1.0)],
                              "district_id int, edge_id int, src int, dst int, length_m double")
    c = {r.edge_id: r.centrality for r in graph.attach_centrality(e, graph.edge_betweenness(e)).collect()}
    assert c == pytest.approx({1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0})


def test_shortest_paths_against_relaxation(spark):
    rng = np.random.default_rng(9)
    n, rows = 40, {}
    for a, b, w in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(10, 99, 90)):
        if a != b:
            rows[(int(min(a, b)), int(max(a, b)))] = float(w)
    d = np.full(n, np.inf)
    d[0] = 0
    for _ in range(n):
        for (a, b), w in rows.items():
            d[b], d[a] = min(d[b], d[a] + w), min(d[a], d[b] + w)
    src = spark.createDataFrame([(0, 0)], "district_id int, node long")
    got = graph.shortest_paths(edges(spark, [(a, b, w) for (a, b), w in rows.items()]), src, 150.0)
    assert {r.node: r.dist for r in got.collect()} == {i: v for i, v in enumerate(d) if v <= 150}


def test_nearest_with_pivots_and_copies(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 6)) + rng.integers(0, 4, (500, 1)) * 5
    x[:170] = x[0]  # a third of the rows are copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    d = np.round(np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)), 6)
    np.fill_diagonal(d, np.inf)
    want = {i: [int(j) for j in np.argsort(d[i], kind="stable")[:4]] for i in range(500)}
    for kw in ({}, {"pivots": 7, "block_rows": 40}):
        got = sim.nearest(df, 4, "id", "vec", **kw).orderBy("id", "rank").collect()
        out = {}
        for r in got:
            out.setdefault(r.id, []).append(r.neighbor)
        assert out == want


def brute_nearest(q, c, k, shared):
    out = {}
    for i, a in q.items():
        found = []
        for j, b in c.items():
            both = ~np.isnan(a) & ~np.isnan(b)
            if i != j and both.any():
                d = np.sqrt(((a - b)[both] ** 2).sum() / (both.sum() if shared else 1))
                found.append((round(float(d), 6), j, int(both.sum())))
        out[i] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("pivots, block_rows", [(None, 1024), (3, 16)])
def test_nearest_with_missing_features(spark, pivots, block_rows):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(260, 5)) + rng.integers(0, 5, (260, 1)) * 4
    x[rng.random((260, 5)) < 0.25] = np.nan
    x[7] = np.nan  # no feature at all: no neighbour and nobody's neighbour
    c, q = {i: r for i, r in enumerate(x[:200])}, {i + 150: r for i, r in enumerate(x[150:])}
    frame = lambda rows: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in rows.items()], "id long, vec array<double>")
    got = {}
    for r in sim.nearest(frame(q), 4, "id", "vec", corpus=frame(c), shared=True, pivots=pivots, block_rows=block_rows).orderBy(
            "id", "rank").collect():
        got.setdefault(r.id, []).append((r.distance, r.neighbor, r.dims))
    want = {i: v for i, v in brute_nearest(q, c, 4, True).items() if v}
    assert {i: [(j, d) for _, j, d in v] for i, v in got.items()} == {i: [(j, d) for _, j, d in v] for i, v in want.items()}
    assert 7 not in got and all(j != 7 for v in got.values() for _, j, _ in v)


def test_search_meets_few_pairs(spark):
    """Rows in groups: two rounds and bounds leave most pairs of rows unseen."""
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=(n, 4)) + rng.integers(0, 12, (n, 1)) * 30
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    met = []
    got = {}
    for r in sim.nearest(df, 3, "id", "vec", met=met).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbor)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)
    np.fill_diagonal(d, np.inf)
    assert got == {i: np.argsort(d[i], kind="stable")[:3].tolist() for i in range(n)}
    *rounds, tree = met
    pairs = sum(int(tree.count[r.cell]) * r["count"] for v in rounds for r in v.groupBy("cell").count().collect())
    assert len(tree.tops) < len(tree.pivots) == 55 and pairs < n * n / 4
    assert sim.nearest(df.where("false"), 3, "id", "vec").count() == sim.nearest(df, 3, "id", "vec", corpus=df.where("false")).count() == 0


def test_typology_fit_checks(spark):
    mix = {"a": ("Community", [0, .6, 0, .2, .1, 0, .1, 0]), "b": ("Community", [0, .55, 0, .25, .1, 0, .1, 0]),
           "c": ("Innovation", [0, .1, 0, .1, .8, 0, 0, 0]), "d": ("Entertainment", [.1, 0, .1, .8, 0, 0, 0, 0]),
           "e": (None, [0, .58, 0, .22, .1, 0, .1, 0])}
    ids = {k: i for i, k in enumerate(mix)}
    sh = spark.createDataFrame([(ids[k], *[float(v) for v in s]) for k, (_, s) in mix.items()],
                               "district_id long, " + ", ".join(f"{b} double" for b in V.BUCKETS))
    lab = spark.createDataFrame([(ids[k], t, None, None) for k, (t, _) in mix.items()],
                                "district_id long, primary string, secondary string, fallback string")
    near = sim.rank_shares(sh, "district_id", V.BUCKETS, 3)
    fit = sim.typology_fit(near, lab, "district_id", V.TYPOLOGIES)
    held = fit.where(F.col("id") == ids["e"]).first()
    assert held.top_type == "Community"
    assert held.pct_community + held.pct_innovation + held.pct_entertainment + held.pct_sports_park == pytest.approx(
        100, abs=0.2)
    why = sim.fit_reason(sh, fit, "district_id").where(F.col("id") == ids["e"]).first().why
    assert why.startswith("residential 58%")


def test_components_of_variance(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) @ np.diag([3, 1, 0.2])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    z = sim.zscore_population(df, ["a", "b", "c"], digits=12)
    proj, share, load = sim.principal_components(z, ["id"], ["a", "b", "c"], 3)
    assert sum(share) == pytest.approx(1) and load.T @ load == pytest.approx(np.eye(3), abs=1e-9)
    assert all(load[np.abs(load[:, j]).argmax(), j] > 0 for j in range(3))
    with pytest.raises(ValueError):
        sim.panel_components(df.withColumn("k", F.lit(1.0)), ["id"], ["a", "k"])


def blobs(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.2, (n, 2)) for c, n in (((0, 0), 9), ((8, 0), 6), ((0, 9), 4))])
    return spark.createDataFrame([(0, i, [float(a), float(b)]) for i, (a, b) in enumerate(x)],
                                 "district_id int, id long, vec array<double>"), x


def ward_loop(x):
    """Merges of the nearest pair, one after the other: (a, b, height, size)."""
    live, out = {i: (np.array(v), 1) for i, v in enumerate(x)}, []
    while len(live) > 1:
        h, a, b = min((round(((live[a][0] - live[b][0]) ** 2).sum() * 2 * live[a][1] * live[b][1] / (live[a][1] + live[b][1]), 9), a, b)
                      for a in live for b in live if a < b)
        (u, m), (v, n) = live[a], live.pop(b)
        live[a] = (u * m + v * n) / (m + n), m + n
        out.append((a, b, round(float(np.sqrt(h)), 6), m + n))
    return out


def leaves_from_left(merges):
    """Leaf ids in order of a walk that visits the left child first."""
    node = {}
    for when, (a, b, h, _) in enumerate(sorted(merges, key=lambda m: (m[2], m[3]))):
        one, two = node.get(a, (-1.0, a, [a])), node.get(b, (-1.0, b, [b]))
        first, second = sorted((one, two), key=lambda c: c[:2])
        node[a] = (h, a, first[2] + second[2])
    return max(node.values(), key=lambda c: len(c[2]))[2]


def test_ward_of_any_block_size(spark):
    rows, x = blobs(spark)
    key = lambda df: sorted((r.a, r.b, round(r.height, 6), r.size) for r in df.collect())
    merges = clustering.ward_merges(rows)
    assert key(merges) == key(clustering.ward_merges(rows, block=3)) == sorted(ward_loop(x))
    # heights are the usual sqrt(2|A||B|/(|A|+|B|)) times the centroid distance
    cut = clustering.cut_tree(rows, merges, 3)
    assert sorted(r["count"] for r in cut.groupBy("cluster_id").count().collect()) == [4, 6, 9]


def test_leaves_from_left_to_right(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 2))
    x[40:44] = x[40]  # copies: merges at height 0
    rows = spark.createDataFrame([(d, i, [float(a), float(b)]) for d in (0, 1) for i, (a, b) in enumerate(x[:60 - 40 * d])],
                                 "district_id int, id long, vec array<double>")
    merges = clustering.ward_merges(rows)
    programs = spark.createDataFrame([(0, 3, "office")], "district_id int, id long, program string")
    got = clustering.leaf_order(merges, programs).collect()
    for d, n in ((0, 60), (1, 20)):
        mine = sorted((r.position, r.id) for r in got if r.district_id == d)
        want = leaves_from_left([(r.a, r.b, r.height, r.size) for r in merges.where(F.col("district_id") == d).collect()])
        assert [p for p, _ in mine] == list(range(n)) and [i for _, i in mine] == want
    assert {r.program for r in got if r.id == 3} == {"office", None}


def test_ward_of_many_rows_and_equal_distances(spark):
    """A grid, where nearly every distance is tied, and 2,000 rows: whole trees with the inertia of the rows."""
    grid = [(0, i, [float(i % 8), float(i // 8)]) for i in range(64)]
    rng = np.random.default_rng(3)
    many = [(1, i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(2000, 3)))]
    one = [(2, 5, [1.0, 2.0])]
    rows = spark.createDataFrame(grid + many + one, "district_id int, id long, vec array<double>")
    m = clustering.ward_merges(rows)
    got = {r.district_id: (r.n, r.s) for r in m.groupBy("district_id").agg(F.count("*").alias("n"), F.sum(F.col("height") ** 2 / 2).alias("s")).collect()}
    total = lambda rs: float(((np.array([v for *_, v in rs]) - np.mean([v for *_, v in rs], axis=0)) ** 2).sum())
    assert set(got) == {0, 1} and got[0][0] == 63 and got[1][0] == 1999
    assert got[0][1] == pytest.approx(total(grid)) and got[1][1] == pytest.approx(total(many))


def test_greedy_dedup_against_loop(spark):
    rng = np.random.default_rng(6)
    pts = [(0, i, f"n{i % 3}" if i % 10 else "", float(x), float(y))
           for i, (x, y) in enumerate(np.round(rng.uniform(0, 160, (400, 2))))]
    pts += [(0, 400 + i, "n1", 50.0, 50.0) for i in range(60)]
    kept, seen = set(), {}
    for _, i, n, x, y in pts:
        if n and any((x - a) ** 2 + (y - b) ** 2 <= 625 for a, b in seen.get(n, [])):
            continue
        kept.add(i)
        if n:
            seen.setdefault(n, []).append((x, y))
    df = spark.createDataFrame(pts, "district_id int, pid int, name string, x double, y double")
    assert {r.pid for r in greedy_dedup(df, "pid", "name", 25.0).collect()} == kept
    assert {r.pid for r in greedy_dedup(df, "pid", "name", 25.0, tile_points=20).collect()} == kept


@pytest.mark.parametrize("gap, tile_points", [(20.0, 20_000), (10.0, 2_000)])
def test_a_long_chain_takes_few_rounds(spark, gap, tile_points):
    n, rounds = 10_000, []
    df = spark.range(n).select(F.lit(0).alias("district_id"), F.col("id").alias("pid"), F.lit("n").alias("name"),
                               (F.col("id") * gap).alias("x"), F.lit(0.0).alias("y"))
    got = sorted(r.pid for r in greedy_dedup(df, "pid", "name", 25.0, tile_points=tile_points, rounds=rounds).collect())
    assert got == list(range(0, n, 2 if gap == 20 else 3)) and len(rounds) < 40


def test_intake_is_idempotent(spark, tmp_path):
    from townloom.streaming import intake

    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    count = lambda d: d.groupBy("k").agg(F.count("*").alias("n"))
    write = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 2).alias("k")).coalesce(1).write.mode(
        "append").parquet(src)
    write(0, 10)
    schema = spark.read.parquet(src).schema
    go = lambda: intake.run_intake(spark, src, schema, "*.parquet", count, out, ck)
    go()
    go()
    write(10, 16)
    go()
    assert {r.k: r.n for r in intake.merged_counts(spark, out, ["k"], "n").collect()} == {0: 8, 1: 8}


def test_demographic_rank_with_ids_of_both_sides(spark):
    """A query whose id a corpus district has too is no reason to leave that district out."""
    schema = "id int, a double, b double"
    corpus = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(9)], schema)
    asked = spark.createDataFrame([(4, 4.2, 1.0)], schema)
    got = sim.rank_demographics(asked, corpus, "id", ["a", "b"], k=9).collect()
    assert sorted(r.neighbor for r in got) == list(range(9)) and min(got, key=lambda r: r["rank"]).neighbor == 4


def test_visits_are_sent_in_bounded_frames():
    part = pd.DataFrame({"id": np.arange(50), "vec": [[float(i)] for i in range(50)]})
    row, cell = np.repeat(np.arange(50), 700), np.tile(np.arange(700), 50)
    frames = list(neighbours.sent_on(part, row, cell))
    assert max(map(len, frames)) <= neighbours.VISIT_ROWS
    whole = pd.concat(frames)
    assert (whole["id"] == row).all() and (whole["cell"] == cell).all() and (whole["vec"].str[0] == row).all()
    dist = np.random.default_rng(4).integers(0, 6, (200, 40)).astype(float)
    dist[dist == 5] = np.inf
    dist[3] = np.inf
    r, c = neighbours.k_smallest(dist, 7)
    order = np.argsort(dist, axis=1, kind="stable")[:, :7]
    want = [(i, j) for i in range(200) for j in order[i] if np.isfinite(dist[i, j])]
    assert list(zip(r, c)) == want
