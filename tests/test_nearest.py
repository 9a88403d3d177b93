"""Nearest vectors with metric pruning, against all distances."""

import numpy as np
import pytest

from riskloom.operators import nearest
from riskloom.operators.nearest import nearest_neighbors


def brute(ids, m, q_ids, q, k, exclude_self):
    out = []
    for i, v in zip(q_ids, q):
        d2 = ((m - v) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d2)) if not (exclude_self and ids[j] == i)][:k]
        out += [(i, r + 1, int(ids[j]), round(float(d2[j]), 4)) for r, j in enumerate(order)]
    return sorted(out)


def clustered(seed, n, dim=8, centres=12, repeats=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 30
    m = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.4
    if repeats:
        m[:repeats] = m[0]
    return m


def frame(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("seed, repeats, block, qblock", [(1, 0, 40, 64), (2, 150, 25, 7)])
def test_equals_all_distances_and_meets_few_blocks(spark, seed, repeats, block, qblock):
    m = clustered(seed, 400, repeats=repeats)
    ids = np.random.default_rng(seed).permutation(400) + 10
    df = frame(spark, ids, m)
    got = nearest_neighbors(df, df, "vec_id", "vec_id", k=3, corpus_block=block, query_block=qblock, exclude_self=True,
                            with_visits=True).collect()
    assert sorted((r.vec_id, r.rank, r.neighbor_id, r.d2) for r in got) == brute(ids, m, ids, m, 3, True)
    all_blocks = 400 / block
    assert np.mean([r.blocks_met for r in got]) < 0.7 * all_blocks


def test_without_structure_every_cell_is_met(spark):
    """Random directions: bounds tell little apart, the result is the same."""
    m = np.random.default_rng(5).normal(size=(150, 24))
    ids = np.arange(150)
    df = frame(spark, ids, m)
    got = nearest_neighbors(df, df, "vec_id", "vec_id", k=5, corpus_block=16, query_block=20).collect()
    assert sorted((r.vec_id, r.rank, r.neighbor_id, r.d2) for r in got) == brute(ids, m, ids, m, 5, False)


def test_odd_rows(spark):
    m = clustered(7, 60, dim=3)
    df = frame(spark, np.arange(60), m)
    odd = spark.createDataFrame([(None, [0.0, 0.0, 0.0]), (900, None), (5, [1.0, 1.0, 1.0]), (5, [2.0, 2.0, 2.0])],
                                df.schema)
    got = nearest_neighbors(odd, df.unionByName(odd), "vec_id", "vec_id", k=2, corpus_block=10, exclude_self=True).collect()
    assert len(got) == 6 and all(r.neighbor_id is not None for r in got)
    assert all(r.neighbor_id != 5 for r in got if r.vec_id == 5)
    few = nearest_neighbors(odd, df.limit(1), "vec_id", "vec_id", k=3).collect()
    assert len(few) == 3  # as many as there are
    assert nearest_neighbors(odd, df.limit(0), "vec_id", "vec_id").count() == 0
    assert nearest_neighbors(df.limit(0), df, "vec_id", "vec_id", corpus_block=5).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    m, q = clustered(9, 300), clustered(10, 50)
    pivots = m[:7]
    far = np.sqrt(((m[:, None] - pivots[None]) ** 2).sum(axis=2))
    at = far.argmin(axis=1)
    least, largest = (np.array([f(far[at == p, p]) for p in range(7)]) for f in (np.min, np.max))
    cells = nearest.Cells(pivots, np.arange(7), least, largest)
    bounds = cells.bounds(q)
    for i, v in enumerate(q):
        for p in range(7):
            assert bounds[i, p] <= np.sqrt(((m[at == p] - v) ** 2).sum(axis=1)).min()
    assert (bounds > 0).any() and rng is not None
