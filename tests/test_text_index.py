"""The kept index after changes, against an index built from scratch."""

import random

from test_postings import corpus

from riskloom.operators.postings import tfidf_topk
from riskloom.operators.text_index import TextIndex


def hits(df, doc):
    return sorted((r["item_id"], r["rank"], r[doc], r["score"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_changes_equal_a_rebuild(spark, tmp_path):
    docs, queries = corpus(4, 120)
    rng = random.Random(4)
    q = spark.createDataFrame(queries, "item_id long, text string")
    state = dict(docs)
    index = TextIndex.create(frame(spark, docs), str(tmp_path / "index"))
    for step in range(3):
        gone = rng.sample(sorted(state), 15)
        index.remove(frame(spark, [(i, None) for i in [*gone, 10**6, None]]))
        for i in gone:
            state.pop(i)
        more, _ = corpus(50 + step, 20)
        new = {i * 7: t for i, t in more} | {gone[0]: "abcde back again"}  # some replace others, one comes back
        index.add(frame(spark, [*new.items(), (None, "no id")]))
        state |= new
        if step == 1:
            index.compact()
        rebuilt = tfidf_topk(q, frame(spark, list(state.items())))
        assert index.size() == len(state)
        assert hits(index.search(q, "item_id"), "doc") == hits(rebuilt, "doc_id")
        df = {r.term: r.df for r in index.frequencies().collect()}
        assert all(n > 0 for n in df.values())
        assert {r.doc for r in index.live_documents().collect()} == set(state)


def test_unpublished_segments_are_not_read(spark, tmp_path):
    index = TextIndex.create(frame(spark, [(1, "alpha beta"), (2, "beta"), (3, None), (4, "")]), str(tmp_path / "index"))
    assert index.size() == 4
    frame(spark, [(9, "alpha")]).selectExpr("doc_id AS doc", "text AS term", "1L AS tf").write.parquet(f"{index.path}/segment-lost/terms")
    q = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert [r.doc for r in index.search(q, "item_id").collect()] == [1]
    index.add(frame(spark, [(2, "alpha"), (2, "gamma")]))  # one document
    assert index.size() == 4
    assert {r.term: r.df for r in index.frequencies().collect()} == {"alpha": 2, "beta": 1, "gamma": 1}


def test_empty(spark, tmp_path):
    index = TextIndex.create(frame(spark, []), str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert index.size() == 0 and index.search(q, "item_id").count() == 0
    index.add(frame(spark, [(5, "alpha")]))
    index.remove(frame(spark, [(5, None)]))
    assert index.size() == 0 and index.frequencies().count() == 0 and index.search(q, "item_id").count() == 0


def test_the_terms_of_a_document_are_one_row(spark, tmp_path):
    """What is held against documents is shuffled as a row for each document, not as postings."""
    index = TextIndex.create(frame(spark, [(1, "alpha beta alpha"), (1, "beta"), (2, ""), (3, "gamma")]), str(tmp_path / "rows"))
    stored = spark.read.parquet(f"{index.path}/segment-*/terms")
    assert {r.doc: dict(zip(r.terms, r.tfs)) for r in stored.collect()} == {1: {"alpha": 2, "beta": 2}, 3: {"gamma": 1}}
    assert sorted((r.doc, r.term, r.tf) for r in index.live_terms().collect()) == [(1, "alpha", 2), (1, "beta", 2), (3, "gamma", 1)]
