"""Clustering against Python's integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
from llm.helpers import SF, write_tables

from riskloom.llm import centroids, queries


def brute(rows, size=64, k=8, rounds=10):
    """(id, cluster, distance, cluster inertia, inertia, digest) of (id, embedding) rows, sorted."""
    kept = [(i, list(x)) for i, x in rows
            if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    def key(r):
        return (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    whole = [[math.floor(Fraction(v) * 1024) for v in x] for _, x in sorted(kept, key=key)]
    ids = [i for i, _ in sorted(kept, key=key)]
    c = [list(v) for v in whole[:k]]

    def nearest():
        out = []
        for v in whole:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = nearest()
        for m in range(len(c)):
            own = [v for v, (n, _) in zip(whole, at) if n == m]
            if own:
                c[m] = [sum(col) // len(own) for col in zip(*own)]
    at, top = nearest(), 2**63 - 1
    near = [min(d, top) for _, d in at]
    inertia = [min(sum(d for (n, _), d in zip(at, near) if n == m), top) for m in range(len(c))]
    whole_sum = min(sum(near), top)
    shas = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, n, d, inertia[n], whole_sum, shas[n]) for i, (n, _), d in zip(ids, at, near)), key=str)


def answer(spark, rows, folder, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, cluster string, id int, x double")
    d = write_tables(spark, folder, embeddings=df)
    return sorted((tuple(r) for r in queries.op13_centroid_clusters(spark, d).collect()), key=str)


def test_query_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_centroid_clusters(spark, SF).collect()), key=str)
    assert got == brute(rows) and len({r[1] for r in got}) > 1


def test_odd_vectors(spark, tmp_path):
    rng = random.Random(4)
    def vector():
        return [rng.randint(-40, 40) / 8 for _ in range(64)]
    same = vector()
    rows = [(k, vector()) for k in range(30)] + [(5, same), (5, same), (None, same), (None, vector()), (90, None), (91, []),
            (92, same[:63]), (93, [*same, 1.0]), (94, [None, *same[1:]]), (95, [math.nan, *same[1:]]),
            (96, [math.inf, *same[1:]]), (97, [-0.0] * 64)] + [(200 + k, same) for k in range(40)]
    full = [(i, x, "c", 1, 0.5) for i, x in rows]
    assert answer(spark, full, tmp_path / "odd") == brute(rows)
    assert answer(spark, full[:3], tmp_path / "three") == brute(rows[:3])
    assert answer(spark, [r for r in full if r[0] in (90, 91)], tmp_path / "none") == []
    assert answer(spark, [], tmp_path / "empty") == []


def test_numbers_beyond_64_bits(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, [rng.choice([1e30, -1e300, 1.5e308, 0.3, 2.0**40, -7.25, 5e-324]) for _ in range(64)]) for k in range(25)]
    rows += [(100 + k, [rng.uniform(-1, 1) for _ in range(64)]) for k in range(25)]
    assert answer(spark, [(i, x, "c", 1, 0.5) for i, x in rows], tmp_path, "double") == brute(rows)


def test_tables_equal_differences():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-2000, 2000, (300, 7)), rng.integers(-2000, 2000, (5, 7))
    assert (centroids.distances(v, c) == ((v[:, None, :] - c[None]) ** 2).sum(axis=2)).all()
    for x in [0, 1, -1, 2**48, -(2**48) - 3, 10**60, -(10**60)]:
        assert sum(d * centroids.BASE**k for k, d in enumerate(centroids.digits(x))) == x
