"""TF-IDF top-k with term upper bounds, against all scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.operators import postings
from riskloom.operators.postings import DocumentBlock, exact_sum, tfidf_topk
from riskloom.operators.retrieval import context_text, prompt_messages


def count(text):
    return Counter(w for w in re.split("[^a-z]+", (text or "").lower()) if w)


def brute(queries, docs, k):
    """(query, rank, document, score) of all scores, one by one."""
    n, tf = len(docs), {i: count(t) for i, t in docs}
    df = Counter(t for c in tf.values() for t in c)

    def weights(c):
        return {t: f * math.log((n + 1) / (df.get(t, 0) + 1)) for t, f in sorted(c.items())}

    def norm(w):
        return math.sqrt(math.fsum(x * x for x in w.values()))

    out = []
    for q, text in queries:
        w = weights(count(text))
        rows = []
        for i, c in tf.items():
            if not c.keys() & w.keys():
                continue
            d = weights(c)
            over = norm(w) * norm(d)
            rows.append((-(sum(w[t] * d[t] for t in w if t in d) / over if over else 0.0), i))
        # scores that are equal but for rounding are ties here as there
        rows.sort(key=lambda r: (round(r[0], 12), r[1]))
        out += [(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(rows[:k])]
    return sorted(out)


def corpus(seed, n, vocabulary=300):
    """Words of very different frequency, some documents twice."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(vocabulary)]
    weight = [1 / (r + 1) for r in range(vocabulary)]
    docs = []
    while len(docs) < n:
        text = " ".join(rng.choices(words, weight, k=rng.randint(1, 60)))
        docs += [(len(docs) + j, text) for j in range(rng.choice([1, 1, 1, 3]))]
    queries = [(k, " ".join(rng.choices(words, weight, k=rng.randint(1, 12)))) for k in range(40)]
    return docs, queries


@pytest.mark.parametrize("seed, blocks", [(1, (20_000, 2_000)), (2, (60, 7))])
def test_equals_all_scores(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(postings, "DOC_BLOCK", blocks[0])
    monkeypatch.setattr(postings, "QUERY_BLOCK", blocks[1])
    docs, queries = corpus(seed, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    got = sorted((r.item_id, r.rank, r.doc_id, r.score) for r in tfidf_topk(q, d, k=4).collect())
    assert got == brute(queries, docs, 4)


def test_hopeless_postings_are_not_read():
    """Many documents with a frequent term, few with a rare one: the frequent postings are read for those alone."""
    n = 5000
    ids, norms = np.arange(n), np.full(n, 10.0)
    frequent = np.full(n, 0.5)
    rare = np.array([7, 90, 4000])
    block = DocumentBlock([("often", ids, frequent), ("rare", rare, np.array([9.0, 8.0, 7.0]))], ids, norms)
    query = [("often", 0.5), ("rare", 9.0)]
    norm = math.hypot(0.5, 9.0)
    got = block.best(query, norm, 3, 7.0 * 9.0 / 10 / norm)
    assert [i for i, _ in got] == [7, 90, 4000] and block.touched < 20
    block.touched = 0
    assert block.best([("often", 0.5)], 0.5, 3, 0.9) == [] and block.touched == 0  # the whole block is skipped
    assert [i for i, _ in block.best([("often", 0.5)], 0.5, 3, 0.0)] == [0, 1, 2]  # ties: the least ids
    assert block.best([("often", 0.0)], 0.0, 2, 0.0) == [(0, 0.0), (1, 0.0)]


def test_fewer_postings_than_there_are():
    """On skewed words with the floor of the k-th impacts, most postings are not read."""
    docs, queries = corpus(3, 2000, vocabulary=2000)
    n, tf = len(docs), [count(t) for _, t in docs]
    df = Counter(t for c in tf for t in c)
    idf = {t: math.log((n + 1) / (m + 1)) for t, m in df.items()}
    norms = np.array([math.sqrt(sum((f * idf[t]) ** 2 for t, f in c.items())) for c in tf])
    lists = {}
    for i, c in enumerate(tf):
        for t, f in c.items():
            lists.setdefault(t, []).append((i, f * idf[t]))
    block = DocumentBlock([(t, np.array([i for i, _ in x]), np.array([w for _, w in x])) for t, x in sorted(lists.items())],
                          np.arange(n), norms)
    every = read = 0
    for _, text in queries:
        w = {t: f * idf[t] for t, f in count(text).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        best = block.best(sorted(w.items()), norm, 1, 0.0)
        block.touched = 0
        assert block.best(sorted(w.items()), norm, 1, best[0][1]) == best
        read += block.touched
        every += sum(len(lists[t]) for t in w)
    assert read < every / 2


def test_queries_without_a_hit_and_odd_texts(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "ДА 123"), (5, "alpha alpha")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "gamma"), (3, None), (4, "")], "item_id long, text string")
    hits = tfidf_topk(q, d)
    assert sorted((r.item_id, r.doc_id) for r in hits.collect()) == [(1, 1), (1, 5)]
    context = context_text(hits, d, "item_id", "doc_id", queries=q)
    assert {r.item_id: r.context for r in context.collect()} == {1: "alpha alpha\n\nalpha beta", 2: "", 3: "", 4: ""}
    messages = prompt_messages(context.withColumn("question", F.lit("why?")), "item_id").collect()
    assert len(messages) == 8
    assert tfidf_topk(q, d.limit(0)).count() == 0 and tfidf_topk(q.limit(0), d).count() == 0


def test_sums_do_not_depend_on_order(spark):
    rng = random.Random(1)
    values = [rng.uniform(0, 10 ** rng.randint(-9, 6)) for _ in range(2000)]
    sums = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3 + seed)
        sums.add(df.agg(exact_sum(F.col("x")).alias("s")).first()[0])
    assert len(sums) == 1 and abs(sums.pop() - math.fsum(values)) < 1e-6


def test_queries_of_the_same_words_are_searched_once(spark):
    """Texts that differ in numbers, case and order only are one group; rows of one id count together."""
    rows = [(k, f"Why was loan {k} DENIED? {k * 7}") for k in range(50)] + [(90, "denied loan"), (90, "was why"), (91, "12"), (None, "why"), (92, "why why")]
    q = spark.createDataFrame(rows, "item_id long, text string")
    members, groups = postings.query_groups(q, "item_id", "text")
    assert {(r.qid, r.bag) for r in groups.collect()} == {(0, "denied loan was why"), (92, "why why")}
    assert sorted(r.item_id for r in members.collect()) == [*range(50), 90, 92]
    d = spark.createDataFrame([(1, "why loan"), (2, "why"), (3, "other")], "doc_id long, text string")
    hits = tfidf_topk(q, d, k=1)
    assert {(r.item_id, r.doc_id) for r in hits.collect()} == {*((k, 1) for k in [*range(50), 90]), (92, 2)}


def test_terms_are_counted_where_they_are_made(spark):
    d = spark.createDataFrame([(1, "a b a"), (1, "b"), (None, "c")], "doc_id long, text string")
    t = postings.terms(d, "doc_id", "text")
    assert sorted((r.doc_id or 0, r.term, r.tf) for r in t.collect()) == [(0, "c", 1), (1, "a", 2), (1, "b", 2)]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1  # of the texts


def test_rare_terms_are_joined_and_frequent_ones_broadcast(spark, monkeypatch):
    """Whatever the share of terms that is broadcast, the results are those of all scores."""
    docs, queries = corpus(5, 200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    for n in (1, 40):
        monkeypatch.setattr(postings, "BROADCAST_TERMS", n)
        assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in tfidf_topk(q, d, k=3).collect()) == brute(queries, docs, 3)


def test_term_lists_count_like_single_words(spark, monkeypatch):
    """Whatever the pieces: rows of one id (or none) count together, also across pieces; odd letters part words."""
    rng = random.Random(8)
    parts = ["Aa", "b", "İb", "K", "é", "ß", "12", "_", "", "zebra", "A-b", "日本", "\n"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, "", "7", " ".join(rng.choices(parts, k=rng.randint(1, 9)))])) for _ in range(150)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    single = whole.select("doc_id", F.explode(postings.words(F.col("text"))).alias("term")).groupBy("doc_id", "term").count()
    expected = sorted(((r[0] or -1, r[1], r[2]) for r in single.collect() if r[0] != 0), key=str)
    for size in (1, 40, 8 << 20):
        monkeypatch.setattr(postings, "COUNT_BYTES", size)
        texts = [(i, (t or "").lower()) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
        batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in x], pa.int64()), pa.array([t for _, t in x], pa.string())], ["a", "b"])
                   for x in (texts[:50], [], texts[50:53], texts[53:])]
        out = [r for b in postings._counted(iter(batches), ["doc_id", "terms", "tfs"]) for r in b.to_pylist()]
        assert len({r["doc_id"] for r in out}) == len(out)  # a row for each id
        found = [(r["doc_id"] or -1, t, n) for r in out for t, n in zip(r["terms"], r["tfs"], strict=True) if r["doc_id"] != 0]
        assert sorted(found, key=str) == expected
    lists = postings.term_lists(whole, "doc_id", "text")
    found = [(r.doc_id or -1, t, n) for r in lists.collect() for t, n in zip(r.terms, r.tfs, strict=True) if r.doc_id != 0]
    assert sorted(found, key=str) == expected
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan  # no word is a row of its own


@pytest.mark.parametrize("name", ["context_text", "prompt_messages"])
def test_texts_are_not_shuffled_for_few_hits(spark, name, tmp_path):
    from riskloom.plans.catalog import registry
    spark.range(40).selectExpr("id doc_id", "concat('loan ', id % 7, ' risk') text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).selectExpr("id item_id", "'risk of a loan' text").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = registry()[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert "BroadcastHashJoin [doc_id" in plan and "SortMergeJoin [doc_id" not in plan


@pytest.mark.parametrize("ids", [500_000, 1])
def test_only_texts_of_repeated_ids_are_dealt(spark, monkeypatch, ids):
    """Rows of one id (or none) count together, whether few ids come again or too many to broadcast."""
    monkeypatch.setattr(postings, "REPEATED_IDS", ids)
    rows = [(k, f"a b{k} a") for k in range(40)] + [(3, "a c"), (5, "b5"), (None, "c"), (None, "c d"), (50, None), (51, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lists = postings.term_lists_in_place(d, "doc_id", "text").collect()
    assert len(lists) == 41 and len({r.doc_id for r in lists}) == 41
    found = sorted((r.doc_id or -1, t, n) for r in lists for t, n in zip(r.terms, r.tfs, strict=True) if r.doc_id != 0)
    single = postings.postings_of(postings.term_lists(d, "doc_id", "text"), "doc_id").collect()
    assert found == sorted((r.doc_id or -1, r.term, r.tf) for r in single if r.doc_id != 0)


def test_documents_are_not_shuffled_for_their_norms(spark, tmp_path):
    """Neither texts nor counted words are shuffled where ids do not come again and the terms fit the list."""
    spark.range(400).selectExpr("id doc_id", "concat('loan risk ', chr(97 + id % 26)) text").repartition(8).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    once = postings.term_lists_in_place(d, "doc_id", "text")
    assert sum(once.count() for _ in range(1)) == 400
    lists, df = postings.indexed(d, "doc_id", "text")
    vocabulary = df.withColumn("idf", F.lit(1.5)).withColumn("n", F.when(F.col("term") == "risk", F.lit(7).cast("long")))
    weighted = postings.weighted_documents(lists, vocabulary, "doc_id")
    assert "Exchange" not in weighted._jdf.queryExecution().executedPlan().toString()
    got = weighted.collect()
    assert len(got) == 400 and all(r.terms == [7] and r.tfs == [1] and abs(r.norm - math.sqrt(3 * 2.25)) < 1e-12 for r in got)
