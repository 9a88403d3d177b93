"""Split invariants and source round trips."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.operators.split import stratified_split
from riskloom.operators.staging import build_layers
from riskloom.session import scratch_path
from riskloom.sources import files
from riskloom.sources.artifacts import read_metrics, write_metrics
from riskloom.sources.fixture import raw_loans


def test_split_independent_of_partitioning(spark):
    mart = build_layers(raw_loans(spark, SF_SMALL))["mart_training"]
    a = {r.loan_id: r.fold for r in stratified_split(mart).collect()}
    b = {r.loan_id: r.fold for r in stratified_split(mart.repartition(7, "dti")).collect()}
    assert a == b


def test_split_sizes_per_class(spark):
    mart = build_layers(raw_loans(spark, SF_SMALL))["mart_training"]
    s = stratified_split(mart)
    got = {(r.target, r.fold): r["count"] for r in s.groupBy("target", "fold").count().collect()}
    for t in (0, 1):
        n = got[(t, "test")] + got[(t, "train")]
        assert got[(t, "test")] == int(n * 0.2)


def test_csv_round_trip_keeps_blanks_and_nulls(spark):
    raw = raw_loans(spark, SF_SMALL)
    path = scratch_path(spark, "csv-test")
    files.write_loans_csv(raw, path)
    back = files.read_loans_csv(spark, path)
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0
    assert back.filter(F.col("term") == " 36 months").count() > 0


def test_load_validation_flags(spark):
    raw = raw_loans(spark, SF_SMALL)
    assert files.load_validation(raw).first().passed
    assert not files.load_validation(raw.limit(0)).first().passed
    assert not files.load_validation(raw.drop("loan_amnt")).first().passed


def test_metrics_sink_round_trip(spark):
    d = scratch_path(spark, "metrics-test")
    write_metrics(spark, {"auc_roc": 0.81, "accuracy": 0.7, "test_size": 10}, d, "t1")
    write_metrics(spark, {"auc_roc": 0.82, "accuracy": 0.71, "test_size": 11}, d, "t2")
    rows = sorted(read_metrics(spark, d).collect(), key=lambda r: r.run_ts)
    assert [r.auc_roc for r in rows] == [0.81, 0.82]


def test_rows_are_not_dealt_by_their_class(spark, tmp_path):
    """The cuts, a row for each class, are broadcast: no task takes all rows of a class."""
    spark.range(3000).selectExpr("id loan_id", "cast(id % 5 = 0 as int) target").write.parquet(f"{tmp_path}/loans")
    split = stratified_split(spark.read.parquet(f"{tmp_path}/loans"))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(coalesce(target" not in plan
    assert {(r.target, r.fold): r["count"] for r in split.groupBy("target", "fold").count().collect()} == {
        (0, "test"): 480, (0, "train"): 1920, (1, "test"): 120, (1, "train"): 480}


def test_train_fold_is_not_kept_in_memory_beside_the_binned_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from riskloom.operators.model import gbt_stage, train_gbt
    from riskloom.schemas import FEATURE_ORDER

    def refuse(df):
        raise AssertionError("the fold is cached")

    rows = spark.range(400).select(*[(F.col("id") % (k + 2)).cast("double").alias(c) for k, c in enumerate(FEATURE_ORDER)],
                                   (F.col("id") % 3 == 0).cast("int").alias("target"))
    monkeypatch.setattr(type(rows), "cache", refuse)
    assert gbt_stage(train_gbt(rows, max_iter=2)).getNumTrees == 2
