"""What is sent, held and written grows with the rows."""

import numpy as np
import pytest

from townloom.operators import neighbours


def frame(spark, ids, x, kind="long"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], f"id {kind}, vec array<double>")


def found(near):
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbor, r.distance))
    return got


def brute(dist, names, k):
    return {names[i]: [(names[j], dist[i, j]) for j in np.argsort(dist[i], kind="stable")[:k] if np.isfinite(dist[i, j])]
            for i in range(len(dist))}


@pytest.mark.parametrize("pivots", [None, 8])
def test_rows_without_groups_are_not_copied_to_cells(spark, monkeypatch, pivots):
    """No bound rules out a cell: queries go in blocks, and the rows sent to cells stay in proportion."""
    monkeypatch.setattr(neighbours, "PAIR_ROWS", 256)
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 100)
    monkeypatch.setattr(neighbours, "TASK_BYTES", 500 * 66 * 8)
    monkeypatch.setattr(neighbours, "SLICE_COLUMNS", 40)
    monkeypatch.setattr(neighbours, "FOUND_ROWS", 100)
    x = np.random.default_rng(3).normal(size=(1200, 64))
    x[:90] = x[0]  # copies
    x[90:140] *= 3
    x[140:143] = 0
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    dist = np.round(1 - u @ u.T, 6)
    np.fill_diagonal(dist, np.inf)
    names = [f"r{i:04d}" for i in range(len(x))]
    met = []
    got = found(neighbours.nearest(frame(spark, names, x, "string"), 5, "id", "vec", "cosine", pivots=pivots, block_rows=64, met=met))
    want = brute(dist, names, 5)
    assert {i: [n for n, _ in v] for i, v in got.items()} == {i: [n for n, _ in v] for i, v in want.items()}
    assert all(abs(d - e) < 1e-9 for i in want for (_, d), (_, e) in zip(got[i], want[i]))
    *rounds, tree = met
    assert sum(v.count() for v in rounds) < 5 * len(x)


@pytest.mark.parametrize("shared", [False, True])
def test_distances_in_blocks(spark, monkeypatch, shared):
    monkeypatch.setattr(neighbours, "SENT_BYTES", 0)
    monkeypatch.setattr(neighbours, "PAIR_ROWS", 70)
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 30)
    monkeypatch.setattr(neighbours, "TASK_BYTES", 150 * 6 * 8)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, 6)), 1) + rng.integers(0, 3, (400, 1)) * 40
    if shared:
        x[rng.random(x.shape) < 0.3] = np.nan
    both = ~np.isnan(x[:, None]) & ~np.isnan(x[None])
    d2 = (np.where(both, x[:, None] - x[None], 0) ** 2).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.round(np.where(both.any(-1), np.sqrt(d2 / both.sum(-1) if shared else d2), np.inf), 6)
    np.fill_diagonal(dist, np.inf)
    got = found(neighbours.nearest(frame(spark, range(400), x), 4, "id", "vec", shared=shared))
    assert got == {i: v for i, v in brute(dist, range(400), 4).items() if v}


def test_hit_rates_send_rows_in_proportion(spark, monkeypatch, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    x = np.random.default_rng(6).normal(size=(1500, 64)).astype("float32")
    rows = [(i, [float(v) for v in r], i % 10) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sent, visits = [], neighbours.visits
    monkeypatch.setattr(neighbours, "visits", lambda *a: sent.append(visits(*a)) or sent[-1])
    got = entry.queries()["m17_hit_rates"](spark, str(tmp_path)).first()
    assert sum(v.count() for v in sent) < 4 * len(rows)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(entry.oracle_sql()["m17_hit_rates"])
    want = dict(zip(rel.columns, rel.fetchall()[0]))
    assert {c: round(got[c], 4) for c in want} == {c: round(v, 4) for c, v in want.items()}


def test_field_metrics_of_stretches(spark):
    """Measured by one task as cell by cell; cells of a district never become rows."""
    from townloom.operators import raster

    rng = np.random.default_rng(12)
    rows, boxes = [], []
    for d in range(9):
        for _ in range(int(rng.integers(0, 60)) if d else 0):  # district 0 has no mask
            first = int(rng.integers(-6, 24))
            rows.append((d, int(rng.integers(-5, 24)), first, first + int(rng.integers(1, 7))))  # some lie beyond the canvas, some on another
        boxes += [(d, 0, 0, 20, int(rng.integers(1, 20)))] if d != 4 else []  # district 4 has no canvas
    rows += [(8, y, 0, 20) for y in range(20)]  # a full one
    mask = spark.createDataFrame(rows, "district_id long, cell_y long, _first long, _end long")
    canvas = spark.createDataFrame(boxes, "district_id long, x_first long, y_first long, x_end long, y_end long")
    small, large = raster.field_metrics(mask, canvas), raster.field_metrics(mask, canvas, limit=0)
    assert small.dtypes == large.dtypes
    got = {r.district_id: tuple(r) for r in small.collect()}
    assert got == {r.district_id: tuple(r) for r in large.collect()} == {
        r.district_id: tuple(r) for r in raster.field_metrics(mask, canvas, limit=500).collect()}
    assert set(got) == set(range(9)) - {4} and got[0][1:6] == (0.0, None, None, None, None) and got[8][6] == 0
    assert "Generate" not in small._jdf.queryExecution().executedPlan().toString()
    for d, (_, _, _, x_end, y_end) in {b[0]: b for b in boxes}.items():
        cells = {(x, y) for k, y, a, e in rows if k == d for x in range(a, e)}
        sizes = parts(cells)
        holes = parts({(x, y) for x in range(x_end) for y in range(y_end)} - cells)
        assert got[d][1] == len(cells) / (x_end * y_end) and got[d][6] == max(holes, default=0)
        if sizes:
            assert got[d][2:6] == (len(sizes), sum(sizes) / len(sizes), float(np.median(sizes)), max(sizes))


def parts(cells):
    left, sizes = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            x, y = todo.pop()
            n += 1
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
        sizes.append(n)
    return sizes
