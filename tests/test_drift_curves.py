"""Drift by sketches and by a stream, thresholds at every score, the written dictionary."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import curves, dynamic, sketch_drift
from riskloom.streaming.drift_stream import psi_by_window, start_drift_stream, window_counts


def brute_psi(base, current, edges):
    def shares(values):
        there = [v for v in values if v is not None and not math.isnan(v)]
        out = [(len(values) - len(there)) / len(values)]
        cuts = [-math.inf, *edges, math.inf]
        return out + [sum(a < v <= b for v in there) / len(values) for a, b in zip(cuts, cuts[1:])]
    total = 0.0
    for p, q in zip(shares(base), shares(current)):
        if p > 0 or q > 0:
            p, q = max(p, 1e-4), max(q, 1e-4)
            total += (q - p) * math.log(q / p)
    return total


def test_sketches_of_parts_equal_exact_bins(spark):
    """With fewer values than a sketch holds its ranks are exact, also after merging."""
    rng = random.Random(3)
    rows = [(f"{p} {k % 5}", rng.choice([None, float("nan"), 1.0, 2.0]) if rng.random() < 0.2 else rng.gauss(m, 1), float(k % 3))
            for p, m in (("base", 0), ("current", 0.7)) for k in range(1500)]
    df = spark.createDataFrame(rows, "month string, x double, y double")
    parts = sketch_drift.feature_sketches(df, F.col("month"), ["x", "y"])
    assert parts.count() == 20
    periods = sketch_drift.merged(parts, F.split("period", " ")[0])
    edges = sketch_drift.edges_of(periods.filter("period = 'base'"))
    got = {r.feature: r for r in sketch_drift.drift_between(periods, "base", "current").collect()}
    for j, f in ((1, "x"), (2, "y")):
        base, current = ([r[j] for r in rows if r[0].startswith(p)] for p in ("base", "current"))
        assert got[f].psi == pytest.approx(brute_psi(base, current, edges[f]), abs=1e-9)
        there = sorted(v for v in base if v is not None and not math.isnan(v))
        for q, e in zip([k / 10 for k in range(1, 10)], edges[f] if f == "x" else []):
            below, upto = sum(v < e for v in there) / len(there), sum(v <= e for v in there) / len(there)
            assert below - 1e-9 <= q <= upto + 1e-9
    assert got["x"].psi > 0.3 > got["y"].psi
    assert sketch_drift.drift_between(periods.limit(0), "base", "current").count() == 0


def test_sketches_without_values(spark):
    df = spark.createDataFrame([("base", None), ("base", None), ("current", 1.0), ("current", None)], "month string, x double")
    periods = sketch_drift.feature_sketches(df, F.col("month"), ["x"])
    row = sketch_drift.drift_between(periods, "base", "current").first()
    assert row.base_shares == [1.0, 0.0] and row.current_shares == [0.5, 0.5]


SCHEMA = "loan_id long, issue_d date, loan_amnt double, dti double"


def loans(days, first=0):
    rng = random.Random(first)
    return [(first + k, d, rng.choice([None, rng.uniform(0, 60_000)]), rng.uniform(-5, 60)) for k, d in enumerate(days)]


def test_stream_equals_batch_with_late_and_repeated_loans(spark, tmp_path):
    from datetime import date, timedelta

    start = date(1996, 1, 1)
    src = tmp_path / "in"
    first = loans([start + timedelta(days=k) for k in range(60)])
    second = [*first[50:], *loans([start + timedelta(days=50 + k) for k in range(60)], 100)]  # some arrive again
    late = loans([start + timedelta(days=3)] * 5, 500)  # long after the watermark
    last = loans([start + timedelta(days=200)], 900)  # closes the windows before
    batches = [first, second, [*late, *last]]
    feats = ["loan_amnt", "dti"]
    out = str(tmp_path / "out")
    for rows in batches:  # one micro-batch each
        spark.createDataFrame(rows + [(None, None, 1.0, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        start_drift_stream(spark, spark.createDataFrame([], SCHEMA).schema, str(src), out, str(tmp_path / "chk"), feats).awaitTermination()
    got = spark.read.schema("window_start timestamp, feature string, bin int, n long").parquet(out)
    accepted = spark.createDataFrame(first + second + last, SCHEMA)  # the late ones are dropped
    want = window_counts(accepted, feats, "issue_d", "loan_id", "28 days", "14 days").filter(
        F.col("window_start") + F.expr("INTERVAL 28 DAYS") <= F.lit(start + timedelta(days=186)).cast("timestamp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    # every closed window against the first one's counts
    one = got.agg(F.min("window_start")).first()[0]
    base = got.filter(F.col("window_start") == one).select("feature", "bin", "n")
    psi = {(r.window_start, r.feature): r.psi for r in psi_by_window(got, base).collect()}
    assert psi[(one, "dti")] == 0 and all(v >= 0 for v in psi.values()) and len(psi) == got.select("window_start").distinct().count() * 2


def test_curve_equals_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0.1, 0.5, rng.random()]), rng.randint(0, 1)) for _ in range(700)] + [(None, 1), (float("nan"), 0), (0.3, None)]
    df = spark.createDataFrame(rows, "score double, target int")
    clean = [(s, t) for s, t in rows if s is not None and s == s and t is not None]
    got = {r.threshold: r for r in curves.threshold_curve(df).collect()}
    assert set(got) == {s for s, _ in clean}
    for x, r in got.items():
        assert (r.tp, r.fp, r.tn, r.fn) == tuple(sum(t == want and (s > x) == above for s, t in clean)
                                                 for want, above in ((1, True), (0, True), (0, False), (1, False)))
    curve = curves.threshold_curve(df)
    high = curves.threshold_for_recall(curve, 0.8).first()
    assert high.tp >= 0.8 * (high.tp + high.fn)
    assert all(r.tp < 0.8 * (r.tp + r.fn) for x, r in got.items() if x > high.threshold)
    cheap = curves.threshold_for_cost(curve, 5, 1).first()
    assert 5 * cheap.fn + cheap.fp == min(5 * r.fn + r.fp for r in got.values())
    empty = curves.threshold_curve(df.limit(0))
    assert empty.count() == 0 and curves.threshold_for_recall(empty, 0.5).count() == 0
    assert curves.threshold_for_recall(curve, 1.01).count() == 0


def test_a_million_categories(spark):
    """Numbered without a list of them on the driver, and the same flags as for few."""
    df = spark.range(1_000_000).select("id", F.concat(F.lit("c"), F.col("id")).alias("kind"), (F.col("id") % 3).cast("string").alias("few"))
    values = dynamic.dictionary(df, ["few", "kind"])
    facts = values.agg(F.count("*").alias("n"), F.min("number").alias("a"), F.max("number").alias("b"),
                       F.countDistinct("number").alias("d")).first()
    assert (facts.n, facts.a, facts.b, facts.d) == (1_000_003, 0, 1_000_002, 1_000_003)
    some = dynamic.one_hot_sparse(df.filter("id < 5"), ["few", "kind"], values=values).orderBy("id").collect()
    assert all(len(r.flags) == 2 and r.flags[0] == r.id % 3 for r in some)


def test_sparse_flags_equal_columns(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "y"), (3, "a", None), (4, None, None), (5, "ä", "x")], "id long, p string, q string")
    wide = dynamic.one_hot_dynamic(df, ["p", "q"])
    names = [c for c in wide.columns if c != "id"]
    want = {r.id: [k for k, c in enumerate(names) if r[c]] for r in wide.collect()}
    assert {r.id: r.flags for r in dynamic.one_hot_sparse(df, ["p", "q"]).collect()} == want
    assert dynamic.one_hot_sparse(df.limit(0), ["p", "q"]).count() == 0
