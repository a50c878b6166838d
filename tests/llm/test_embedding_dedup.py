import math
import tracemalloc

import numpy as np
import pytest
from helpers import Components

from slimctx.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, cid int, links int, i int, copies int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0, 0, 0, 0) for i, v, lab in rows], SCHEMA)


def brute(rows, threshold=0.98):
    ok = [r for r in rows if r[0] is not None and r[1] and r[2] is not None
          and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    c, n = Components([r[0] for r in rows if r[0] is not None]), {r[0]: 0 for r in rows}
    unit = [np.array(r[1], np.float32).astype(float) for r in ok]
    unit = [u / np.linalg.norm(u) for u in unit]
    for a in range(len(ok)):
        for b in range(len(ok)):
            if a != b and ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) \
                    and unit[a] @ unit[b] >= threshold:
                n[ok[a][0]] += 1
                c.link(ok[a][0], ok[b][0])
    return {i: (n[i], None if i is None else c.find(i)) for i in n}


def vectors(seed, n=260, dim=12):
    rnd = np.random.RandomState(seed)
    centers = rnd.randn(30, dim)
    rows = []
    for i in range(n):
        v = centers[rnd.randint(30)] + rnd.choice([0, .03, .1, .3]) * rnd.randn(dim)
        rows.append((i, [float(x) for x in np.float32(v * rnd.choice([1, 5]))], int(rnd.randint(2))))
    rows += [(n + 1, rows[0][1], rows[0][2]), (n + 2, rows[0][1], 1 - rows[0][2]), (n + 3, None, 1),
             (n + 4, [0.0] * dim, 1), (n + 5, [float("nan")] + [1.0] * (dim - 1), 1), (n + 6, [], 1),
             (n + 7, [None] + [1.0] * (dim - 1), 1), (n + 8, rows[1][1], None),
             (n + 9, rows[2][1][:5], 0), (n + 10, rows[2][1][:5], 0),
             (n + 11, [float("inf")] + [1.0] * (dim - 1), 1), (n + 12, [1e-30] * dim, 0),
             (n + 13, [1e30] * dim, 0), (n + 14, [3.0], 0), (n + 15, [2.0], 0), (n + 16, [-2.0], 0)]
    return rows


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_against_brute_force(spark, seed, small, monkeypatch):
    if small:
        for name, value in (("INDEX_BLOCK", 5), ("QUERY_BLOCK", 7), ("PER_COLUMN", 4), ("SAMPLE", 90)):
            monkeypatch.setattr(E, name, value)
    rows = vectors(seed)
    got = E.embedding_dedup(table(spark, rows + rows[:4]), sample=E.SAMPLE).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_of_a_shorter_reach(spark):
    rows = vectors(5, 400, 16)
    exact = sum(r.n_links for r in E.embedding_dedup(table(spark, rows)).collect())
    near = sum(r.n_links for r in E.embedding_dedup(table(spark, rows), reach=0.5).collect())
    assert exact and 0.9 * exact <= near <= exact


def test_bounds_hold():
    rnd = np.random.RandomState(3)
    x = E.matrix(__import__("pyarrow").array(rnd.randn(200, 8).tolist()), 8)[:, :4]
    half = E.Half(E.kmeans(x, 9))
    near, bound = half.bounds(x)
    d = E.squares(x, x)
    for i in range(200):
        assert (d[i] + 1e-9 >= bound[i, near]).all()
    cells = E.visited(bound[0], bound[1], 0.04)
    flat = {(i, int(j)) for i, js in cells for j in js}
    assert flat == {(i, j) for i in range(len(half.c)) for j in range(len(half.c))
                    if bound[0][i] + bound[1][j] <= 0.04}


def test_spanning_keeps_components():
    u, v = np.array([5, 9, 7, 1, 20]), np.array([9, 7, 3, 1, 21])
    nodes, root = E._spanning(u, v)
    assert dict(zip(nodes.tolist(), root.tolist())) == {1: 1, 3: 3, 5: 3, 7: 3, 9: 3, 20: 20, 21: 20}


def test_empty_ties_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1), (3, v, 1), (3, [-1.0, 0.0, 0.0], 1), (4, [-2.0, 0.0, 0.0], 1), (9, v, 1)]
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0)
                 for r in E.embedding_dedup(table(spark, rows)).collect())
    assert got == [(0, 0, 0), (3, 1, 3), (3, 1, 3), (4, 1, 3), (9, 1, 3)]
    assert E.embedding_dedup(table(spark, rows).limit(0)).count() == 0
    assert [r.n_links for r in E.embedding_dedup(table(spark, [(1, None, 1)])).collect()] == [0]


def test_plane_bounds_in_bounded_memory():
    rng = np.random.RandomState(3)
    for k, n in ((5, 1), (7, 0), (256, 3000)):
        half, x = E.Half(rng.randn(k, 8)), rng.randn(n, 8)
        tracemalloc.start()
        near, low = half.bounds(x)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6 and near.shape == (n,) and low.shape == (n, k)
        d = E.squares(x, half.c)
        for r in range(0, n, 100):
            plane = ((d[r][:, None] - d[r][None]) / half.gaps).max(1)
            assert np.array_equal(low[r], np.maximum(plane - E.SLACK, 0) ** 2)
            assert near[r] == d[r].argmin()
