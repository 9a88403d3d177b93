"""Exact clustering of vectors around centroids, in whole numbers (operator 13).

Method: scalar lookup tables.  Components are turned into integers once, floor
of ``scale`` times the value.  In each round the squared difference of every
integer that occurs in a dimension to every centroid's component is tabulated,
for each Arrow batch; distances are gathers from these tables, summed over the
dimensions, and no difference is calculated for a vector's own component.

How the work is dealt out: the vectors are written once; a round is one pass over
them that gives, from each task, exact sums for each cluster and dimension,
which are added up by Spark.  Only centroids (k rows of ``size`` integers)
reach the driver and go back to the tasks; every round starts from the written
table and a few integers, so a lost executor repeats tasks of one round.

All numbers are exact: integers beyond what 64 bits can square go through
Python's integers, and sums leave a task in digits of ``BASE``.

Defined results: vectors with another number of components, or with one that is
null, NaN or infinite, are left out; repeated rows are vectors of their own, a
repeated id can be several starting centroids (equal ids in the order of their
components, null ids last); with fewer than k vectors there are as many
centroids; of no vector there is no row; distances and sums beyond the largest
64-bit integer are given as that integer.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ready

#: Digits in which sums leave a task.
BASE = 1 << 48
LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where their squares could need more."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() <= _small(x.shape[1]):
        return scaled.astype(np.int64)
    whole = [[math.floor(v * scale) if abs(v) < 1 << 52 else int(v) * scale for v in row] for row in x.tolist()]
    return np.array(whole, dtype=object)


def _small(size: int) -> int:
    """Largest size of integers whose squared distance in ``size`` dimensions fits 63 bits."""
    return math.isqrt((1 << 62) // max(size, 1)) // 2


def centroid_array(centroids: list[list[int]], size: int) -> np.ndarray:
    small = all(abs(c) <= _small(size) for row in centroids for c in row)
    return np.array(centroids, dtype=np.int64 if small else object).reshape(len(centroids), size)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector to every centroid, from a table for each dimension."""
    kind = np.int64 if v.dtype == centroids.dtype == np.int64 else object
    total = np.zeros((len(v), len(centroids)), dtype=kind)
    for d in range(v.shape[1]):
        occurring, at = np.unique(v[:, d], return_inverse=True)
        table = (occurring.astype(kind)[:, None] - centroids[None, :, d].astype(kind)) ** 2
        total += table[at]
    return total


def digits(x: int) -> list[int]:
    """Digits of an integer, lowest first, with its sign."""
    sign, x, out = (1, x) if x >= 0 else (-1, -x), abs(x), []
    while x:
        x, low = divmod(x, BASE)
        out.append(sign[0] * low)
    return out


def _batches(batches: Iterator[pa.RecordBatch], size: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of each batch."""
    for b in batches:
        if b.num_rows:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield b.column(0), integers(x.reshape(b.num_rows, size), scale)


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(cluster, dim, digit, part) of a task; dimension -1 has the number of vectors."""
    c = centroid_array(centroids, size)
    sums = [[0] * size for _ in centroids]
    counts = [0] * len(centroids)
    for _, v in _batches(batches, size, scale):
        nearest = distances(v, c).argmin(axis=1)  # of equal ones the first
        for k in range(len(c)):
            own = v[nearest == k]
            counts[k] += len(own)
            if len(own):
                sums[k] = [a + int(b) for a, b in zip(sums[k], own.sum(axis=0).tolist(), strict=True)]
    out = [(k, d, place, digit) for k, row in enumerate(sums) for d, x in enumerate([*row, counts[k]])
           for place, digit in enumerate(digits(x))]
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    yield pa.record_batch({n: pa.array(col, t) for n, col, t in zip(
        ("cluster", "dim", "digit", "part"), columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)})


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], size: int, scale: int) -> Iterator[pa.RecordBatch]:
    c = centroid_array(centroids, size)
    for ids, v in _batches(batches, size, scale):
        d = distances(v, c)
        nearest = d.argmin(axis=1)
        far = [min(int(x), LONG) for x in d[np.arange(len(d)), nearest]]
        yield pa.record_batch({"id": ids, "cluster": pa.array(nearest.astype(np.int32)), "distance": pa.array(far, pa.int64())})


def moved(kept: DataFrame, centroids: list[list[int]], size: int, scale: int) -> list[list[int]]:
    """The centroids after a round: floor of the mean of their vectors, as they were without any."""
    parts = kept.mapInArrow(partial(_sums, centroids=centroids, size=size, scale=scale),
                            "cluster int, dim int, digit int, part long")
    sums = parts.groupBy("cluster", "dim", "digit").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    total = [[0] * (size + 1) for _ in centroids]
    for r in sums.collect():  # k * (size + 1) numbers
        total[r["cluster"]][r["dim"]] += int(r["part"]) * BASE ** r["digit"]
    return [[s // row[size] for s in row[:size]] if row[size] else old for row, old in zip(total, centroids, strict=True)]


def cluster(vectors: DataFrame, id_column: str = "vec_id", embedding: str = "embedding", size: int = 64, k: int = 8,
            rounds: int = 10, scale: int = 1024, seed: str = "3") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with ``size`` components."""
    spark = ready(vectors.sparkSession)
    finite = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    kept = keep(vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{embedding}`").alias("x"))
                .filter((F.size("x") == size) & finite), "cluster-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last()
    first = kept.orderBy(order, "x").limit(k).collect()
    centroids = [integers(np.array([r["x"]], dtype=np.float64), scale)[0].tolist() for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids, size, scale)
    kind = kept.schema["id"].dataType.simpleString()
    if not centroids:
        return spark.createDataFrame([], f"{id_column} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    near = keep(kept.mapInArrow(partial(_assigned, centroids=centroids, size=size, scale=scale),
                                f"id {kind}, cluster int, distance long"), "cluster-assigned")
    found = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # k rows
    inertia = {r["cluster"]: int(r["sum"]) for r in found}
    facts = spark.createDataFrame(
        [(c, min(s, LONG), min(sum(inertia.values()), LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
         for c, s in inertia.items()], "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(facts), F.col("cluster") == F.col("of")).select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
