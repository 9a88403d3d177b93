"""Tree attributions: exact against brute-force Shapley values, and additive."""

import itertools
import math
import os

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import attribution, ranking
from riskloom.operators.attribution import _contributions, tree_tables


def _brute_force(spark, model, x):
    """Shapley values of the path-dependent value function, by enumeration."""
    gbt = model.stages[-1]
    path = os.path.join(spark.sparkContext.getCheckpointDir(), "bf-model")
    gbt.write().overwrite().save(path)
    rows = spark.read.parquet(path + "/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold").collect()
    trees = {}
    for r in rows:
        trees.setdefault(r[0], {})[r[1]] = r[2:]
    weights = gbt.treeWeights
    n = len(x)

    def v(tree, nid, subset):
        pred, cnt, left, right, f, thr = tree[nid]
        if left < 0:
            return pred
        if f in subset:
            return v(tree, left if x[f] <= thr[0] else right, subset)
        lc, rc = tree[left][1], tree[right][1]
        return (lc * v(tree, left, subset) + rc * v(tree, right, subset)) / cnt

    def value(subset):
        return sum(2 * w * v(trees[t], min(trees[t]), subset) for t, w in zip(sorted(trees), weights))

    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for r in range(n):
            for s in itertools.combinations(others, r):
                w = math.factorial(r) * math.factorial(n - r - 1) / math.factorial(n)
                phi[i] += w * (value(set(s) | {i}) - value(set(s)))
    return phi, value(set())


def test_exact_against_brute_force(spark):
    df = spark.range(400).selectExpr(
        "cast(id % 7 as double) a", "cast(id % 5 as double) b", "cast(id % 11 as double) c",
        "cast(id % 3 as double) d",
        "cast(((id % 7) + (id % 5) * (id % 3) + (id % 11) / 3) > 6 as double) target")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features"),
        GBTClassifier(labelCol="target", maxIter=4, maxDepth=3, seed=42)]).fit(df)
    tt = tree_tables(spark, model)
    sample = df.limit(6).toPandas()[["a", "b", "c", "d"]].to_numpy()
    fast = _contributions(sample, tt)
    for row, phi_fast in zip(sample, fast):
        phi_bf, base_bf = _brute_force(spark, model, row)
        assert np.allclose(phi_fast, phi_bf, atol=1e-10)
        assert abs(tt.base_value - base_bf) < 1e-10
    margins = model.transform(df.limit(6)).select(
        vector_to_array("rawPrediction")[1].alias("m")).toPandas()["m"].to_numpy()
    assert np.allclose(tt.base_value + fast.sum(axis=1), 2 * margins, atol=1e-10)


def test_subtree_tables_equal_leaf_tables(spark, monkeypatch):
    """However many decisions a subtree may hold, down to single leaves, the values are the same."""
    df = spark.range(600).selectExpr(
        "cast(id % 7 as double) a", "cast(id % 5 as double) b", "cast(id % 11 as double) c", "cast(id % 13 as double) d",
        "cast(((id % 7) * (id % 13) + (id % 5) * (id % 3) + (id % 11) / 3) > 20 as double) target")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features"),
        GBTClassifier(labelCol="target", maxIter=3, maxDepth=5, seed=42)]).fit(df)
    x = df.limit(200).toPandas()[["a", "b", "c", "d"]].to_numpy()
    values = {}
    for bits in (0, 4, 9):
        monkeypatch.setattr(attribution, "SUBTREE_BITS", bits)
        tt = attribution._build_tables(spark, model.stages[-1])
        values[bits] = _contributions(x, tt)
        assert all(len(s.nodes) <= bits for s in tt.subtrees)
        if bits == 9:
            assert not tt.leaves and len(tt.subtrees) <= 4 * 3
    assert np.allclose(values[0], values[9], atol=1e-12) and np.allclose(values[4], values[9], atol=1e-12)


def test_contributions_are_sorted_once(spark):
    """Steps and top features name the sorted array several times; the plan sorts it once."""
    df = spark.range(5).selectExpr("id", "0.5D AS base_value", "cast(id AS double) a", "cast(-id AS double) b", "1D AS shap_a", "cast(-2 - id AS double) shap_b")
    keyed = df.select("id", "base_value", ranking.keyed_contributions(["a", "b"]).alias("contributions"))
    steps = ranking.waterfall_steps(keyed, "id")
    top = keyed.select("id", ranking.top_features(F.col("contributions"), 1).alias("top"))
    for plan in (steps, top):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1
    assert [(r.step, r.feature, r.start, r.end) for r in steps.filter("id = 1").collect()] == [(1, "b", 0.5, -2.5), (2, "a", -2.5, -1.5)]
    assert [r.top[0].feature for r in top.collect()] == ["b"] * 5
