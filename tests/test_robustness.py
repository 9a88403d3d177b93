"""Null, tied, repeated and extreme values outside what the fixture holds."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import applications as A
from riskloom.operators import dynamic, metrics, split
from riskloom.operators.attribution import _contributions, tree_tables
from riskloom.operators.chunking import split_text
from riskloom.operators.drift import feature_drift
from riskloom.operators.embedding import as_float_array, embed_chunks, embed_with, vector_entries
from riskloom.operators.model import latest_path
from riskloom.operators.retrieval import best_of_block, nearest_neighbors, tfidf_topk
from riskloom.operators.staging import materialize_layers
from riskloom.plans.model_queries import _covered
from riskloom.session import is_local, scratch_path, work_dir
from riskloom.sources import files
from riskloom.sources.fixture import raw_loans


def test_more_than_a_thousand_categories(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), F.col("id") % 1500).alias("kind"))
    out = dynamic.one_hot_dynamic(df, ["kind"])
    assert len(out.columns) == 1501
    assert out.filter(F.col("kind_c7")).count() == 2


def test_numeric_columns_need_no_categories(spark, monkeypatch):
    monkeypatch.setattr(dynamic, "categories", lambda *a: pytest.fail("a job for flags that are dropped"))
    assert "target" in dynamic.training_matrix(raw_loans(spark, "/root/testdata/sf0.001")).columns


def test_neighbours_closer_than_the_rounding(spark):
    corpus = spark.createDataFrame([(1, [0.006, 0.0]), (2, [0.001, 0.0]), (3, None)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [0.0, 0.0]), (10, None)], "id long, embedding array<double>")
    rows = nearest_neighbors(queries, corpus, "id", "id", k=1).collect()
    assert [(r.id, r.neighbor_id, r.d2) for r in rows] == [(9, 2, 0.0)]


def test_block_kernel_is_exact():
    rng = np.random.default_rng(3)
    c = np.concatenate([rng.normal(size=(300, 24)), np.repeat(rng.normal(size=(3, 24)), 20, axis=0)]) * 1e3
    q, ids = c[::7] + 1e-7, np.arange(len(c), dtype=np.int64)
    got = best_of_block(np.arange(len(q)), q, ids, c, 5, False)
    for i in range(len(q)):
        d2 = ((c - q[i]) ** 2).sum(axis=1)
        want = np.lexsort((ids, d2))[:5].tolist()
        assert [j for k, j, _ in got if k == i] == want


def test_tfidf_with_zero_norms_and_ties(spark):
    docs = spark.createDataFrame([(1, "same words"), (2, "same words")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "same words"), (8, "")], "item_id long, text string")
    rows = tfidf_topk(q, docs).collect()
    assert [(r.item_id, r["rank"], r.doc_id, r.score) for r in rows] == [(7, 1, 1, 0.0), (7, 2, 2, 0.0)]


def test_tfidf_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=None)) for _ in range(150)] + ["wa wb wc"] * 5
    queries = [" ".join(rng.choice(words, 6)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "item_id long, text string")
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in tfidf_topk(q, docs).collect()}
    df = {w: sum(w in t.split() for t in texts) for w in words}
    idf = {w: math.log((len(texts) + 1.0) / (df[w] + 1)) for w in words}

    def vector(t):
        return np.array([t.split().count(w) * idf[w] for w in words])

    m = np.stack([vector(t) for t in texts])
    for i, t in enumerate(queries):
        v = vector(t)
        score = np.round(m @ v / (np.linalg.norm(m, axis=1) * np.linalg.norm(v)), 12)
        want = np.lexsort((np.arange(len(texts)), -score))[:3]
        assert [got[i, k + 1][0] for k in range(3)] == want.tolist()


@pytest.mark.parametrize("every", [20, 10, 2])
def test_split_keeps_rows_without_id(spark, every):
    df = spark.range(1000).select(F.when(F.col("id") % every != 0, F.col("id")).alias("loan_id"),
                                  F.when(F.col("id") % 7 != 0, (F.col("id") % 3 == 0).cast("int")).alias("target"))
    out = split.stratified_split(df)
    assert out.count() == 1000
    for label in (0, 1, None):
        rows = out.filter(F.col("target").eqNullSafe(F.lit(label)))
        known = rows.filter("loan_id IS NOT NULL").count()
        assert rows.filter("fold = 'test'").count() == int(known * 0.2)
    assert out.filter("loan_id IS NULL AND fold = 'test'").count() == 0


def test_split_repeated_ids_share_a_fold(spark):
    df = spark.range(400).select((F.col("id") % 50).alias("loan_id"), F.lit(1).alias("target"))
    out = split.stratified_split(df)
    assert out.count() == 400
    assert out.groupBy("loan_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0


def test_no_decision_without_a_probability(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (0.6,)], "default_risk double")
    rows = A.with_decision(df).collect()
    assert [r.decision for r in rows] == [None, None, "APPROVED", "DENIED"]
    assert [r.prediction for r in rows] == [None, None, 0, 1]


def test_null_scores_are_in_no_count(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (None, 1), (float("nan"), 1), (0.7, None)], "score double, target int")
    c = metrics.confusion(df).first()
    s = metrics.threshold_sweep(df, thresholds=[0.5]).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.recall) == (s.tp, s.fp, s.tn, s.fn, s.recall) == (1, 0, 1, 0, 1.0)
    assert metrics.accuracy(df).first().accuracy == 1.0


def test_drift_beyond_the_bounds_shows(spark):
    rows = [("base", 25000.0 + k) for k in range(100)] + [("current", 39999.0 + k) for k in range(100)]
    inside = [("base", 25000.0 + k) for k in range(100)] + [("current", 39899.0 + k) for k in range(100)]
    base = [("base", 39900.0 + k / 2) for k in range(100)]
    bounds = {"loan_amnt": (1000, 40000)}

    def psi(data):
        df = spark.createDataFrame(data, "period string, loan_amnt double")
        return feature_drift(df, "period", "base", "current", bounds).first().psi

    assert psi(rows) > 1 and psi(inside) > 1
    assert psi(base + [("current", 39900.0 + k / 2) for k in range(100)]) == 0
    assert psi(base + [("current", 50000.0)] * 100) > 1  # above the upper bound is not the last bin


def _gbt(spark, df):
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                            GBTClassifier(labelCol="target", maxIter=3, maxDepth=2, seed=1)])


def test_attributions_of_a_refit_are_its_own(spark):
    df = spark.range(300).selectExpr("cast(id % 7 as double) a", "cast(id % 5 as double) b",
                                     "cast(id % 7 > 3 as double) target")
    other = df.withColumn("target", 1.0 - F.col("target"))
    pipeline = _gbt(spark, df)
    first, second = pipeline.fit(df), pipeline.fit(other)
    assert first.stages[-1].uid == second.stages[-1].uid
    x = np.array([[6.0, 1.0], [1.0, 2.0]])
    frame = spark.createDataFrame(x.tolist(), ["a", "b"])
    for model in (first, second):
        tt = tree_tables(spark, model)
        margins = [r.m for r in model.transform(frame).select(vector_to_array("rawPrediction")[1].alias("m")).collect()]
        assert np.allclose(tt.base_value + _contributions(x, tt).sum(axis=1), 2 * np.array(margins), atol=1e-10)


def test_records_with_all_reasons(spark, tmp_path):
    good = ('{"app_id": 1, "loan_amnt": 10000, "term": "36 months", "int_rate": 13.0, "installment": 300, "grade": "C", '
            '"sub_grade": "C3", "annual_inc": 60000, "dti": 20.0, "emp_length": "3 years", "fico": 700, '
            '"home_ownership": "RENT", "purpose": "debt_consolidation", "open_acc": 8, "pub_rec": 0, "revol_bal": 15000, '
            '"revol_util": 50.0, "total_acc": 20, "mort_acc": 0, "pub_rec_bankruptcies": 0}')
    bad = good.replace('"app_id": 1', '"app_id": 2').replace('"fico": 700', '"fico": "high"').replace(
        '"dti": 20.0', '"dti": 75.0').replace('"grade": "C"', '"grade": "Z"').replace('"mort_acc": 0, ', "")
    (tmp_path / "a.json").write_text("\n".join([good, bad, good[:40], "no json"]) + "\n")
    rows = A.checked_records(files.read_application_records(spark, str(tmp_path))).collect()
    by_record = {r.record: (r.app_id, r.violations) for r in rows}
    assert by_record[good] == (1, [])
    assert by_record[bad] == (2, ["grade:value", "dti:range", "fico:type", "mort_acc:missing"])
    assert by_record[good[:40]][1] == by_record["no json"][1] == [A.MALFORMED]


def test_valid_by_filters_equals_no_violation(spark):
    apps = A.applications_from_loans(raw_loans(spark, "/root/testdata/sf0.001"))
    checked = A.with_violations(apps).withColumn("ok", A.is_valid())
    assert checked.filter(F.col("ok").isNull() | (F.col("ok") != (F.size("violations") == 0))).count() == 0


def test_form_sub_grades(spark):
    df = spark.createDataFrame([(1, "A1"), (2, "G5"), (3, "H1"), (4, None)], "app_id long, sub_grade string")
    for c in ("term", "grade", "emp_length", "home_ownership", "purpose"):
        df = df.withColumn(c, F.lit("x"))
    assert [r.ok_sub_grade for r in A.enum_checks(df).collect()] == [True, True, False, None]


def test_layers_are_views_and_the_mart_is_written(spark):
    path = scratch_path(spark, "mart-test")
    layers = materialize_layers(raw_loans(spark, "/root/testdata/sf0.001"), path)
    assert spark.read.parquet(path).count() == spark.table("mart_training").count() == 928
    assert spark.table("stg_loans").count() == layers["stg_loans"].count() == 952


def test_many_documents_to_a_file(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None), (4, "é\x1d")], "id long, text string")
    path = scratch_path(spark, "policies-test")
    files.write_policies(docs.coalesce(1), path, "id", "text")
    rows = files.read_policies(spark, path, files.RECORD_SEPARATOR).collect()
    assert sorted(r.text for r in rows) == ["1\na\n\nb", "2\n", "3\n", "4\né\x1d"]


def test_latest_needs_a_published_model(spark, tmp_path):
    (tmp_path / "published").mkdir()
    with pytest.raises(FileNotFoundError):
        latest_path(str(tmp_path))


def test_work_folder_only_local(spark):
    assert is_local("local") and is_local("local[4]") and not is_local("local-cluster[2,1,1024]")
    assert not is_local("spark://host:7077") and work_dir(spark)


def test_chunking_long_unbroken_text_in_linear_time():
    text = "x" * 300_000
    chunks = split_text(text)
    assert all(len(c) <= 500 for c in chunks) and _covered(text, chunks)
    assert split_text("") == [] and split_text(" \n ") == []


def test_chunk_overlap_and_coverage():
    words = " ".join(f"w{i:03d}" for i in range(300))
    chunks = split_text(words, 500, 50)
    assert all(len(c) <= 500 for c in chunks) and _covered(words, chunks)
    for a, b in zip(chunks, chunks[1:]):
        shared = next(n for n in range(50, 0, -1) if a.endswith(b[:n].strip()) and b[:n].strip())
        assert 40 <= shared <= 50
    assert not _covered(words, chunks[:-1]) and not _covered(words, chunks[1:])


def test_embeddings_by_function_and_as_arrays(spark):
    df = spark.createDataFrame([(1, "red blue blue"), (2, "red"), (3, None)], "id int, chunk string")
    got = {r.id: r.embedding for r in embed_with(df, lambda ts: [[float(len(t)), 1.0] for t in ts]).collect()}
    assert got == {1: [13.0, 1.0], 2: [3.0, 1.0], 3: [0.0, 1.0]}
    emb, model = embed_chunks(df.filter("chunk IS NOT NULL"), keep_tokens=True)
    rows = {r.id: r for r in emb.select("id", "tokens", vector_entries().alias("e")).collect()}
    assert rows[1].tokens == ["red", "blue", "blue"] and len(rows[1].e["indices"]) == 2
    small, _ = embed_chunks(df.filter("id = 1"), model=model)
    assert len(as_float_array(small).first().embedding) == rows[1].e["size"]
