import numpy as np

from decant.llm import vectors


def build(spark, rows):
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return d.selectExpr("*", *[f"'x' as {c}" for c in ("key", "cls", "vec", "n", "cell", "size", "label", "home")])


def plain(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {i: (0, rows[i][0]) for i in range(len(rows))}
    for size in {len(rows[i][1]) for i in ok}:
        own = [i for i in ok if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in own], dtype=np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        label = np.arange(len(own))
        for _ in range(len(own)):
            new = np.array([min([label[a], *label[near[a]]]) for a in range(len(own))])
            if (new == label).all():
                break
            label = new
        for a, i in enumerate(own):
            ids = [rows[own[b]][0] for b in np.flatnonzero(label == label[a]) if rows[own[b]][0] is not None]
            out[i] = (int(near[a].sum()), min(ids, default=None))
    return sorted(((rows[i][0], *out[i]) for i in out), key=str)


def test_against_plain(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(40):
        base = rng.normal(size=32)
        for _ in range(1 + g % 6):
            rows.append((2000 - len(rows), (base + rng.normal(size=32) * rng.choice([0.0, 0.1, 0.25, 0.45])).tolist()))
    rows += [(5000 + i, rng.normal(size=32).tolist()) for i in range(600)]
    hot = rng.normal(size=32)
    rows += [(7000 + i, hot.tolist()) for i in range(150)] + [(7500 + i, (hot + rng.normal(size=32) * 0.15).tolist()) for i in range(200)]
    rows += [(1, None), (2, []), (3, [0.0] * 32), (4, [float("nan")] * 32), (5, [None] + [1.0] * 31), (6, [float("inf")] + [1.0] * 31), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, rows[0][1]), (None, [-0.0] * 31 + [1.0]), (9, [0.0] * 31 + [1.0]), (10, [1e-30] * 32), (rows[3][0], rows[3][1])]
    got = vectors.near_duplicates(build(spark, rows)).collect()
    want = plain(rows)
    found, all_ = sum(r.n_links for r in got), sum(n for _, n, _ in want)
    assert found >= 0.98 * all_
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    if found == all_:
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want


def test_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=16)
    rows = [(i, (hot + rng.normal(size=16) * 0.2).tolist()) for i in range(500)]
    got = vectors.near_duplicates(build(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == plain(rows)


def test_empty(spark):
    assert vectors.near_duplicates(build(spark, [])).collect() == []


def test_visitors_meet_only_the_blocks_of_a_cells_own(spark, monkeypatch):
    """One class of a cell's own and 40 visitors: five blocks meet one, so a visitor is one row, and every pair stands in one task."""
    monkeypatch.setattr(vectors, "BLOCK", 10)
    rows = [(bytes([i]), bytes([i]), 1, 0 if i < 3 else 1, [0] if i < 3 else [0, 1], 1) for i in range(43)]
    members = spark.createDataFrame(rows, "cls binary, vec binary, n long, home int, cells array<int>, size int")
    d = vectors._pairs_of_blocks(members).filter("cell = 0").collect()
    assert max(r.i for r in d) == 0 and max(r.j for r in d) == 4
    assert sum(r.home == 1 for r in d) == 40 and all(r.cells is None for r in d if r.home == 1)
    pairs = [(bytes(a.cls), bytes(b.cls)) for a in d if a.here for b in d if b.meet and (a.i, a.j) == (b.i, b.j)]
    assert sorted(pairs) == sorted((bytes([a]), bytes([b])) for a in range(3) for b in range(43))
