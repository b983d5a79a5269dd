"""Links against all pairs, and the lattice itself."""

import math
import random

import numpy as np

from netquarry.llm import lattice


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(500, 8)) * 2
    p = lattice.nearest_e8(y)
    twice = np.rint(p * 2).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1) & (p.sum(1) % 2 == 0)).all()
    around = p[:, None] + np.concatenate([lattice.ROOTS, lattice.ROOTS * 2])[None]
    assert (((y - p) ** 2).sum(1)[:, None] <= ((y[:, None] - around) ** 2).sum(2) + 1e-9).all()
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS ** 2).sum(1), 2)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = lattice.unit(rng.normal(size=(1500, 64)))
    b = rng.normal(size=a.shape)
    b = lattice.unit(b - (a * b).sum(1, keepdims=True) * a)
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * b
    args = (lattice.TABLES, lattice.GROUPS, lattice.PROBES, lattice.SCALE, 5)
    meet = [len(np.intersect1d(x, y)) > 0 for x, y in zip(lattice.cells(a, *args), lattice.cells(b, *args))]
    assert np.mean(meet) >= 0.98


def brute(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    links = {i: [] for i in range(len(rows))}
    for d in {len(v) for (_, v, _), o in zip(rows, ok) if o}:
        idx = [i for i, (r, o) in enumerate(zip(rows, ok)) if o and len(r[1]) == d]
        x = lattice.unit(np.array([rows[i][1] for i in idx]))
        for i, near in zip(idx, x @ x.T >= least):
            links[i] = [j for j, n in zip(idx, near) if n and j != i]
    out, seen = {}, {}
    for i in links:
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            for j in group:
                seen[j] = min(rows[k][0] for k in group)
        out[i] = (rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i])
    return sorted(out.values())


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 2, 5, 40, 300):
        center = rng.normal(size=16)
        rows += [(0, (center + rng.normal(size=16) * 0.12).astype(np.float32).tolist(), 1) for _ in range(size)]
    rows += [(0, rng.normal(size=16).astype(np.float32).tolist(), 1) for _ in range(200)]
    rows += [(0, rng.normal(size=4).astype(np.float32).tolist(), 1) for _ in range(30)]
    rows += [(0, rows[3][1], 2)] * 50 + [(0, (np.array(rows[3][1]) * 4).tolist(), 2)]
    rows += [(0, v, 3) for v in (None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [float("inf")] * 16, [1e38] * 16, [-0.0, 1.0])]
    random.Random(1).shuffle(rows)
    rows = [(10 + 3 * i if i % 90 else 10, v, label) for i, (_, v, label) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = lattice.near_duplicates(df, block=32).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows)


def test_empty_table(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
