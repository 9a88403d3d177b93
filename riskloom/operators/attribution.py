"""Exact additive feature attributions for Spark GBT models.

Path-dependent TreeSHAP (Lundberg et al., 2018/2020): the value of a
feature subset S is the tree's expectation when features in S follow the
row and the others are averaged by training cover.  For one leaf whose
path tests the distinct features D (|D| <= depth), only whether the row
satisfies each feature's path conditions matters, so the leaf's
contribution to every feature depends on one of 2^|D| bit patterns.  The
leaves of a subtree depend on the decisions at its nodes and on the way to it
alone, so the tables of leaves are added up to one table per subtree
with few such decisions.  We precompute these once on the driver (the model is small and
bounded by trees x leaves), broadcast them, and on executors look up rows by
pattern in vectorised numpy over Arrow batches (``mapInPandas``).

Scale: the tables grow with the model, not the data; the per-row work is a
fixed number of vector operations per subtree.  A scan with a split for each
core is used as it is; only smaller inputs (one file) are spread first.

Attributions are on the log-odds scale: ``base_value + sum(shap)`` equals
``logit(default_risk)`` (Spark's GBT margin times two).
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FEATURE_ORDER
from ..session import scratch_path, ship_package, spark_context, spread
from .model import MODEL_INPUTS, gbt_stage

LOGIT_SCALE = 2.0  # Spark GBT: p = 1 / (1 + exp(-2 * margin))
#: Decisions that a subtree's table covers at most (its patterns: two to that power).
SUBTREE_BITS = 9


@dataclass
class LeafTable:
    tree: int
    features: list        # distinct features on the path, in pattern-bit order
    steps: list           # [(node_index, goes_left, feature)] along the path
    table_t: np.ndarray   # (m, 2**m) contribution per feature and pattern


@dataclass
class SubtreeTable:
    tree: int
    nodes: list           # node indexes in pattern-bit order: the way to the subtree, then its own
    features: list
    table: np.ndarray     # (features, 2**nodes) summed contribution of its leaves per pattern


@dataclass
class TreeTables:
    nodes: list = field(default_factory=list)      # per tree: (feature_idx array, threshold array)
    subtrees: list = field(default_factory=list)   # SubtreeTable list
    leaves: list = field(default_factory=list)     # LeafTable list of the leaves too deep for a subtree
    base_value: float = 0.0
    n_features: int = 0


def _shapley_weights(m: int) -> list[float]:
    return [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]


@lru_cache(maxsize=None)
def _subset_algebra(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For m path features, with subsets and patterns both coded as m-bit
    integers: bits (2^m, m); contained[p, s] = 1 iff subset s lies inside
    pattern p; and the Shapley weight of each subset by its size."""
    codes = np.arange(1 << m)
    bits = ((codes[:, None] >> np.arange(m)) & 1).astype(bool)
    contained = ((codes[:, None] & codes[None, :]) == codes[None, :]).astype(np.float64)
    w = np.array(_shapley_weights(m) + [0.0])  # a subset of all m features never counts
    return bits, contained, w[bits.sum(axis=1)]


def _leaf_table(value: float, feats: list[int], z: dict[int, float]) -> np.ndarray:
    """Contribution of one leaf to each path feature, for every pattern of
    'row satisfies this feature's path conditions' bits (bit k = feature k).

    For feature i and pattern p it sums, over subsets S of the other
    features that p satisfies, w(|S|) times the cover fractions of the
    features outside S and i; one matrix product does every (p, i).
    """
    m = len(feats)
    bits, contained, w_size = _subset_algebra(m)
    zs = np.array([z[f] for f in feats], dtype=np.float64)
    outside = bits[None, :, :] | np.eye(m, dtype=bool)[:, None, :]   # (i, S, k): k in S or k == i
    rest = np.prod(np.where(outside, 1.0, zs), axis=2)               # (i, S)
    coef = np.where(bits.T, 0.0, w_size[None, :] * rest)              # S containing i does not count
    return value * (contained @ coef.T) * (bits.astype(np.float64) - zs)


def tree_tables(spark: SparkSession, model: PipelineModel) -> TreeTables:
    """Read the GBT's node table (saved model data) and build leaf tables, once for each model object.

    They are kept on the object itself: a refit has the uid of its estimator, so the uid does not
    tell two models apart.
    """
    gbt = gbt_stage(model)
    tables = getattr(gbt, "_riskloom_tree_tables", None)
    if tables is None:
        tables = gbt._riskloom_tree_tables = _build_tables(spark, gbt)
    return tables


def _build_tables(spark: SparkSession, gbt) -> TreeTables:
    path = scratch_path(spark, "gbt-trees")
    gbt.write().overwrite().save(path)
    rows = (spark.read.parquet(os.path.join(path, "data"))
            .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount",
                    "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                    "nodeData.split.leftCategoriesOrThreshold")
            .collect())  # bounded by the model: trees x nodes
    weights = list(gbt.treeWeights)
    by_tree: dict[int, dict[int, tuple]] = {}
    for r in rows:
        by_tree.setdefault(r[0], {})[r[1]] = tuple(r[2:])
    tt = TreeTables(n_features=gbt.numFeatures)
    base = 0.0
    for t in sorted(by_tree):
        nodes = by_tree[t]
        ids = sorted(nodes)
        index = {nid: k for k, nid in enumerate(ids)}
        feat = np.array([nodes[n][4] for n in ids], dtype=np.int64)
        thr = np.array([(nodes[n][5][0] if nodes[n][5] else np.nan) for n in ids])
        tt.nodes.append((feat, thr))
        scale = LOGIT_SCALE * weights[t]
        root = min(ids)
        root_cover = float(nodes[root][1])
        leaves = {}

        def walk(nid, path, z, cover):
            nonlocal base
            pred, cnt, left, right, f, _ = nodes[nid]
            if left < 0:
                value = scale * pred
                base += value * cover
                feats = []
                for _, fi, _ in path:
                    if fi not in feats:
                        feats.append(fi)
                if feats:
                    leaves[nid] = LeafTable(len(tt.nodes) - 1, feats, [(index[n], gl, fi) for n, fi, gl in path],
                                            np.ascontiguousarray(_leaf_table(value, feats, z).T))
                return
            for child, goes_left in ((left, True), (right, False)):
                frac = nodes[child][1] / cnt if cnt else 0.0
                z2 = dict(z)
                z2[f] = z2.get(f, 1.0) * frac
                walk(child, path + [(nid, f, goes_left)], z2, cover * frac)

        walk(root, [], {}, 1.0 if root_cover else 0.0)
        for way, own, under in _subtrees(nodes, root):
            if len(way) + len(own) <= SUBTREE_BITS:
                tt.subtrees.append(_subtree_table([index[n] for n in way + own], [leaves[n] for n in under if n in leaves]))
            else:
                tt.leaves += [leaves[n] for n in under]
    tt.subtrees = [s for s in tt.subtrees if s is not None]
    tt.base_value = base
    return tt


def _subtrees(nodes: dict[int, tuple], root: int) -> list[tuple[list, list, list]]:
    """(nodes on the way, own inner nodes, leaves) of subtrees that hold every leaf once: the largest with at
    most ``SUBTREE_BITS`` decisions, or a single leaf that has more on its way."""
    inner, under = {}, {}
    todo, order = [root], []
    while todo:
        nid = todo.pop()
        order.append(nid)
        if nodes[nid][2] >= 0:
            todo += [nodes[nid][2], nodes[nid][3]]
    for nid in reversed(order):
        _, _, left, right, _, _ = nodes[nid]
        if left < 0:
            inner[nid], under[nid] = [], [nid]
        else:
            inner[nid], under[nid] = [nid, *inner[left], *inner[right]], [*under[left], *under[right]]
    out, todo = [], [(root, [])]
    while todo:
        nid, way = todo.pop()
        if nodes[nid][2] < 0 or len(way) + len(inner[nid]) <= SUBTREE_BITS:
            out.append((way, inner[nid], under[nid]))
        else:
            todo += [(nodes[nid][3], [*way, nid]), (nodes[nid][2], [*way, nid])]
    return out


def _pattern(leaf: LeafTable, g) -> np.ndarray:
    """The leaf's pattern of each row, from its decisions by node (whether it goes left)."""
    sat = {}
    for node, gl, f in leaf.steps:
        ok = g[node] if gl else ~g[node]
        sat[f] = ok if f not in sat else (sat[f] & ok)
    pattern = sat[leaf.features[0]].astype(np.int64)
    for bit, f in enumerate(leaf.features[1:], start=1):
        pattern |= sat[f].astype(np.int64) << bit
    return pattern


def _subtree_table(nodes: list, leaves: list[LeafTable]) -> SubtreeTable | None:
    """The leaves' tables added up for every pattern of decisions at ``nodes``."""
    if not leaves:
        return None
    codes = np.arange(1 << len(nodes))
    g = {node: (codes >> bit) & 1 == 1 for bit, node in enumerate(nodes)}
    features = sorted({f for leaf in leaves for f in leaf.features})
    table = np.zeros((len(features), len(codes)))
    for leaf in leaves:
        pattern = _pattern(leaf, g)
        for k, f in enumerate(leaf.features):
            table[features.index(f)] += leaf.table_t[k][pattern]
    return SubtreeTable(leaves[0].tree, nodes, features, table)


def _contributions(x: np.ndarray, tt: TreeTables) -> np.ndarray:
    """(rows, features) attributions; feature-major arrays keep every
    per-node and per-feature access contiguous."""
    xt = np.ascontiguousarray(x.T)
    phi_t = np.zeros((tt.n_features, x.shape[0]))
    goes_left = []
    for feat, thr in tt.nodes:
        internal = np.nonzero(feat >= 0)[0]
        g = np.zeros((len(feat), x.shape[0]), dtype=bool)
        for node in internal:
            np.less_equal(xt[feat[node]], thr[node], out=g[node])
        goes_left.append(g)
    for s in tt.subtrees:
        g = goes_left[s.tree]
        code = np.zeros(x.shape[0], dtype=np.int64)
        for bit, node in enumerate(s.nodes):
            code += g[node] * np.int64(1 << bit)
        for row, f in zip(s.table, s.features):
            phi_t[f] += row[code]
    for leaf in tt.leaves:
        pattern = _pattern(leaf, goes_left[leaf.tree])
        for k, f in enumerate(leaf.features):
            phi_t[f] += leaf.table_t[k][pattern]
    return phi_t.T


def attribute(spark: SparkSession, model: PipelineModel, transformed: DataFrame,
              keep: list[str]) -> DataFrame:
    """Attach attributions to rows already passed through ``model.transform``
    (they carry the imputed model inputs).  Output: keep columns, the 36
    feature values, base_value, logit and one ``shap_<feature>`` per feature.
    Row-local (``mapInPandas``): no join; an input that already has a split
    for each core is not shuffled."""
    ship_package(spark)
    tt = tree_tables(spark, model)
    sc = spark_context(spark)
    bc = sc.broadcast(tt) if sc is not None else None  # else shipped inside the closure
    extra = [c for c in MODEL_INPUTS if c not in FEATURE_ORDER]
    passthrough = list(keep) + [c for c in FEATURE_ORDER if c not in keep]
    src = spread(transformed.select(*passthrough, *extra), factor=1)
    out_schema = T.StructType(
        [src.schema[c] for c in passthrough]
        + [T.StructField("base_value", T.DoubleType()), T.StructField("logit", T.DoubleType())]
        + [T.StructField(f"shap_{c}", T.DoubleType()) for c in FEATURE_ORDER])
    shap_cols = [f"shap_{c}" for c in FEATURE_ORDER]

    def run(batches):
        tables = bc.value if bc is not None else tt
        for pdf in batches:
            x = pdf[MODEL_INPUTS].to_numpy(dtype=np.float64)
            phi = _contributions(x, tables)
            extra_cols = pd.DataFrame(phi, columns=shap_cols, index=pdf.index)
            extra_cols.insert(0, "logit", tables.base_value + phi.sum(axis=1))
            extra_cols.insert(0, "base_value", tables.base_value)
            yield pd.concat([pdf[passthrough], extra_cols], axis=1)

    return src.mapInPandas(run, out_schema)


def contribution_array() -> F.Column:
    """Keyed array<struct<neg_abs, pos, feature, value, shap>> in feature order,
    from the feature value columns and the shap_* columns (see ranking)."""
    from .ranking import keyed_contributions
    return keyed_contributions(FEATURE_ORDER)
