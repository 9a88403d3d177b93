"""Benchmark items in documents against exact containment of every pair."""

import random
import re

from llm.helpers import SF, TINY, empty_documents, odd_documents, write_tables
from oracle_harness import compare, duck
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, queries, stages


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def brute(docs, items, least=0.8):
    out = set()
    for i, t in docs:
        d = shingles(t)
        for j, u in items:
            q = shingles(u)
            if q and len(q & d) >= least * len(q):
                out.add((i, j, len(q), len(q & d)))
    return out


def test_query_equals_sql(spark):
    r = compare(spark, SF, "op6", queries.op6_decontamination, queries.OP6_SQL, duck(SF))
    assert r["match"] and r["spark_rows"] > 5, r


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in queries.op6_decontamination(spark, SF).collect()}
    assert got == brute(docs, items)


def test_damaged_items_of_all_sizes(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 9, 12, 20, 37, 64, 130])))) for k in range(60)]
    items += [(100, "too short here"), (101, ""), (102, None), (0, "another text of the same item id as before")]
    docs = []
    for k in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if passage:
                    passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = passage
        docs.append((k, "  ".join(words).title() + "."))
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 50
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == want and len(got) == len(want)


def test_stage_odd_and_empty(spark, tmp_path):
    items = spark.createDataFrame([(1, "The quick brown fox jumps!"), (None, "word word word word word"), (3, None)],
                                  "item_id long, text string")
    odd = odd_documents(spark)
    d = write_tables(spark, tmp_path, benchmark=items, documents=odd)
    kept = stages.drop_contaminated(spark, odd, d)
    assert kept.columns == odd.columns
    assert kept.filter(F.col("text").contains("fox")).count() == 0
    assert kept.count() == odd.filter("NOT coalesce(text LIKE '%fox%' OR text LIKE 'word word%', false)").count()
    assert {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, d).collect()} == {
        (1, 1), (2, 1), (None, 1), (8, None)}
    assert decontaminate.contained_items(empty_documents(spark), items).count() == 0
    assert decontaminate.contained_items(odd, items.limit(0)).count() == 0


def test_native(spark):
    plan = queries.op6_decontamination(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
