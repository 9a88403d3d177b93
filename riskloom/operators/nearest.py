"""Exact nearest vectors by metric pruning.

The corpus is dealt into *cells*: every vector goes to the nearest of some
pivots (vectors of the corpus, at most ``PIVOTS``), and the vectors of a pivot
are cut into rings by their distance to it.  A cell has a least and a largest
distance, so by the triangle inequality a query at distance ``d`` from the
pivot is at least ``max(d - largest, least - d)`` from all of its vectors, and
at least half of ``d`` less the distance to its own nearest pivot.

A query visits the cells in the order of these bounds, a few in each round
(1, 4, 16, ...).  After each round it has the k best so far; cells whose bound is
above the k-th distance are never visited, for it and, as distances only fall,
for all rounds to come.  Cells at the same distance as the k-th are visited, so ties
are complete.  Rounding is allowed for by ``SLACK``.

What is moved: corpus vectors are written once with their cell.  In a round
only queries that still ask for cells go to these cells, and a cell's vectors go
to its askers; no side is copied to all blocks of the other.  A cell larger than
a block of the memory budget is split by id into blocks with the same bounds; a
cell that very many queries ask for is met in several groups of queries.  The
driver holds the pivots and a few numbers of each cell, PIVOTS * RINGS at most.
What no bound can tell apart is compared: the search stays exact.

Defined results: null vectors and corpus vectors without an id are in no result;
every row of the queries is a query of its own; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RETRIEVAL_K
from ..session import scratch_path, ship_package

#: Bytes of float64 vectors in a group, of either side, when block sizes are not given, and of one product.
CORPUS_BLOCK_BYTES = 64 * 1024 * 1024
QUERY_BLOCK_BYTES = 4 * 1024 * 1024
PRODUCT_BYTES = 64 * 1024 * 1024
#: Pivots and rings of each, at most.
PIVOTS, RINGS = 1024, 16
#: Relative allowance for rounding when a bound decides.
SLACK = 1e-6
#: Factor by which the cells of a round grow.
GROWTH = 4


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, by one product (with its rounding, never below 0)."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T), 0.0)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, exclude_self: bool,
                  own: np.ndarray | None = None, most: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """(query, corpus id, exact squared distance) of the k nearest of one block, for each query; with
    ``exclude_self`` its ``own`` id (else its name) is left out, and distances above ``most`` need not be given."""
    own = q_ids if own is None else own
    c_norm, out = (c * c).sum(axis=1), []
    step = max(1, PRODUCT_BYTES // (8 * len(c)))
    for start in range(0, len(q), step):
        part = q[start:start + step]
        bound = squared_distances(part, c)
        # rounding of the product: far above its error, far below any distance that matters
        slack = 1e-9 * ((part * part).sum(axis=1) + c_norm.max())
        for i, row in enumerate(bound):
            at = start + i
            if exclude_self:
                row[c_ids == own[at]] = np.inf
            kth = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            if most is not None:
                kth = min(kth, most[at])
            near = np.flatnonzero((row <= kth + 2 * slack[i]) & (row < np.inf))
            d2 = ((c[near] - part[i]) ** 2).sum(axis=1)
            ids = c_ids[near]
            out += [(int(q_ids[at]), int(ids[j]), float(d2[j])) for j in np.lexsort((ids, d2))[:k]]
    return out


class Cells:
    """Pivots, and of each cell its pivot, least and largest distance."""

    def __init__(self, pivots: np.ndarray, pivot: np.ndarray, least: np.ndarray, largest: np.ndarray):
        self.pivots, self.pivot, self.least, self.largest = pivots, pivot, least, largest

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """A lower bound of the distance of each query to the vectors of each cell."""
        far = np.sqrt(squared_distances(q, self.pivots))
        slack = SLACK * (1 + np.sqrt((q * q).sum(axis=1)) + np.sqrt((self.pivots**2).sum(axis=1)).max())[:, None]
        d = far[:, self.pivot]
        ball = np.maximum(d - self.largest[None, :], self.least[None, :] - d)
        plane = (d - far.min(axis=1)[:, None]) / 2  # a cell's vectors are nearer to its pivot than to any other
        return np.maximum(np.maximum(ball, plane) - slack, 0.0)

    def next_of(self, q: np.ndarray, met: np.ndarray, kth: np.ndarray, step: int) -> list[np.ndarray]:
        """For each query the next ``step`` cells in the order of their bounds that the k-th distance allows."""
        out = []
        rows = max(1, PRODUCT_BYTES // (8 * max(len(self.pivot), len(self.pivots))))
        for start in range(0, len(q), rows):
            bounds = self.bounds(q[start:start + rows])
            order = np.argsort(bounds, axis=1, kind="stable")
            for i, (b, o) in enumerate(zip(bounds, order, strict=True)):
                taken = o[met[start + i]:met[start + i] + step]
                out.append(taken[b[taken] <= kth[start + i]])
        return out


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def build_cells(corpus: DataFrame, n: int, block: int, pivots: int | None) -> tuple[DataFrame, Cells, dict[int, int]]:
    """``corpus`` (cid, cv) with its ``cell``; the cells; and the blocks that each needs."""
    wanted = min(PIVOTS, max(1, math.ceil(n / block))) if pivots is None else pivots
    first = corpus.orderBy(F.xxhash64("cid"), "cid").limit(wanted).collect()
    points = matrix([r["cv"] for r in first])

    @F.pandas_udf("struct<pivot:int,far:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        x = matrix(v)
        at = np.concatenate([squared_distances(x[k:k + 4096], points).argmin(axis=1) for k in range(0, len(x), 4096)])
        return pd.DataFrame({"pivot": at.astype(np.int32), "far": np.sqrt(((x - points[at]) ** 2).sum(axis=1))})

    placed = _written(corpus.withColumn("p", place("cv")).select("cid", "cv", "p.pivot", "p.far"), "nearest-corpus")
    edges = F.percentile_approx("far", [j / RINGS for j in range(1, RINGS)], 1000).alias("edges")
    sizes = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), edges).collect()  # PIVOTS rows
    cut = {r["pivot"]: [r["edges"][j * RINGS // m - 1] for j in range(1, m)]
           for r in sizes for m in [min(RINGS, math.ceil(r["n"] / block))]}
    base, starts = 0, {}
    for p in sorted(cut):
        starts[p], base = base, base + len(cut[p]) + 1
    rings = placed.sparkSession.createDataFrame(
        [(p, starts[p], cut[p]) for p in cut], "of int, start int, cuts array<double>")
    celled = placed.join(F.broadcast(rings), F.col("pivot") == F.col("of")).withColumn(
        "cell", F.col("start") + F.size(F.filter("cuts", lambda e: e < F.col("far")))).select("cid", "cv", "cell", "pivot", "far")
    facts = celled.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.count(F.lit(1)).alias("n"),
                                       F.min("far").alias("least"), F.max("far").alias("largest")).collect()
    facts = sorted(facts, key=lambda r: r["cell"])
    renumbered = {r["cell"]: k for k, r in enumerate(facts)}  # a ring between equal cuts is empty
    celled = celled.withColumn("cell", _lookup(renumbered, F.col("cell"))).drop("pivot", "far")
    cells = Cells(points, np.array([r["pivot"] for r in facts]), np.array([r["least"] for r in facts]),
                  np.array([r["largest"] for r in facts]))
    return celled, cells, {k: math.ceil(r["n"] / block) for k, r in enumerate(facts)}


def _lookup(values: dict[int, int], key: Column) -> Column:
    """The value of a small number of consecutive-ish keys, by an array literal."""
    top = max(values, default=0)
    return F.element_at(F.lit([int(values.get(k, 1)) for k in range(top + 1)]), key + 1)


def nearest_neighbors(queries: DataFrame, corpus: DataFrame, q_id: str, c_id: str,
                      vec: str = "embedding", k: int = RETRIEVAL_K, query_block: int | None = None,
                      corpus_block: int | None = None, exclude_self: bool = False,
                      decimals: int = 4, pivots: int | None = None, with_visits: bool = False) -> DataFrame:
    """(q_id, rank, neighbor_id, d2): the k corpus vectors nearest each query by exact squared L2,
    ties broken by neighbor id; only the reported ``d2`` is rounded to ``decimals``.

    Blocks are as large as a memory budget allows: by default their sizes follow from the vector
    dimension (about 64 MB of corpus and 4 MB of queries in a group, one vector at least).  ``with_visits`` adds
    the blocks that the query met.
    """
    spark = queries.sparkSession
    ship_package(spark)
    asked = queries.filter(F.col(vec).isNotNull()).select(F.col(q_id).cast("long").alias("qid"), F.col(vec).alias("qv"))
    source = corpus.select(F.col(c_id).cast("long").alias("cid"), F.col(vec).alias("cv")).filter("cid IS NOT NULL AND cv IS NOT NULL")
    if query_block is None or corpus_block is None:
        first = source.select(F.size("cv")).first()  # one row: the dimension
        row_bytes = 8 * max(int(first[0]) if first else 1, 1)
        corpus_block = corpus_block or max(1, CORPUS_BLOCK_BYTES // row_bytes)
        query_block = query_block or max(1, QUERY_BLOCK_BYTES // row_bytes)
    n = source.count()
    asked = asked.withColumn("row", F.monotonically_increasing_id())
    if not n or (n <= corpus_block and pivots is None):  # one block: nothing to prune
        asks = asked.withColumns({"cell": F.lit(0), "most": F.lit(float("inf"))})
        got = _met(asks, source.withColumn("cell", F.lit(0)), {0: asked.count()}, {0: 1}, query_block, k, exclude_self)
        first = Window.partitionBy("row").orderBy("d2", "cid")
        ranked = got.withColumn("at", F.row_number().over(first) - 1).filter(F.col("at") < k).select(
            "qid", F.lit(1).alias("blocks"), "at", F.struct("d2", "cid").alias("b"))
        return _result(ranked, q_id, decimals, with_visits)
    celled, cells, blocks = build_cells(source, n, corpus_block, pivots)
    best = "array<struct<d2:double,cid:bigint>>"
    state = _written(asked.withColumns({"met": F.lit(0), "blocks": F.lit(0), "best": F.array().cast(best)}), "nearest-queries")
    done, step = 0, 1
    while done < len(blocks):
        asks = _written(_wanted(state, cells, done, step, k), "nearest-asks")
        found = {r["cell"]: r["count"] for r in asks.groupBy("cell").count().collect()}  # a row for each cell
        if not found:
            break
        got = _met(asks, celled, found, blocks, query_block, k, exclude_self)
        merged = got.groupBy("row").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "cid"))), 1, k).alias("new"))
        count = asks.groupBy("row").agg(F.sum(_lookup(blocks, F.col("cell"))).alias("more"))
        both = F.slice(F.sort_array(F.concat("best", F.coalesce("new", F.array().cast(best)))), 1, k)
        state = _written(state.join(merged, "row", "left").join(count, "row", "left").select(
            "row", "qid", "qv", (F.col("met") + step).alias("met"),
            (F.col("blocks") + F.coalesce("more", F.lit(0))).alias("blocks"), both.alias("best")), "nearest-queries")
        done, step = done + step, step * GROWTH
    return _result(state.select("qid", "blocks", F.posexplode("best").alias("at", "b")), q_id, decimals, with_visits)


def _result(ranked: DataFrame, q_id: str, decimals: int, with_visits: bool) -> DataFrame:
    columns = [F.col("qid").alias(q_id), (F.col("at") + 1).alias("rank"), F.col("b.cid").alias("neighbor_id"),
               F.round("b.d2", decimals).alias("d2")]
    return ranked.select(*columns, *([F.col("blocks").alias("blocks_met")] if with_visits else []))


def _wanted(state: DataFrame, cells: Cells, done: int, step: int, k: int) -> DataFrame:
    """(row, qid, qv, cell, most): the cells that queries ask for next."""
    @F.pandas_udf("array<int>")
    def ask(qv: pd.Series, kth: pd.Series) -> pd.Series:
        bound = np.sqrt(kth.to_numpy(dtype=np.float64)) * (1 + SLACK)
        return pd.Series([a.astype(np.int32) for a in cells.next_of(matrix(qv), np.full(len(qv), done), bound, step)])

    kth = F.when(F.size("best") == k, F.col("best")[k - 1]["d2"]).otherwise(F.lit(float("inf")))
    return state.withColumn("most", kth).select("row", "qid", "qv", F.explode(ask("qv", "most")).alias("cell"), "most")


def _met(asks: DataFrame, celled: DataFrame, found: dict[int, int], blocks: dict[int, int], query_block: int, k: int,
         exclude_self: bool) -> DataFrame:
    """(row, qid, cid, d2) of the k nearest in each block that a query asked for."""
    groups = {c: math.ceil(m / query_block) for c, m in found.items()}
    n_blocks, n_groups = _lookup(blocks, F.col("cell")), _lookup(groups, F.col("cell"))
    q = asks.withColumns({"grp": F.pmod(F.xxhash64("row"), n_groups).cast("int"),
                          "block": F.explode(F.sequence(F.lit(0), n_blocks - 1))})
    c = celled.filter(F.col("cell").isin(list(found))) if len(found) < len(blocks) else celled
    c = c.withColumns({"block": F.pmod(F.xxhash64("cid"), n_blocks).cast("int"),
                       "grp": F.explode(F.sequence(F.lit(0), n_groups - 1))})

    def kernel(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(qs) and len(cs):
            own = qs["qid"].to_numpy()  # NaN, a query without an id, equals no id
            found_rows = best_of_block(qs["row"].to_numpy(dtype=np.int64), matrix(qs["qv"]), cs["cid"].to_numpy(dtype=np.int64),
                                 matrix(cs["cv"]), k, exclude_self, own, qs["most"].to_numpy(dtype=np.float64))
            names = dict(zip(qs["row"], qs["qid"].astype("Int64"), strict=True))
            rows = [(r, names[r], c, d) for r, c, d in found_rows]
        return pd.DataFrame(rows, columns=["row", "qid", "cid", "d2"]).astype(
            {"row": "int64", "qid": "Int64", "cid": "int64", "d2": "float64"})

    keys = ["cell", "block", "grp"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(lambda a, b: kernel(a, b), "row long, qid long, cid long, d2 double")
