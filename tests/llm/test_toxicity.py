"""Toxicity: segments against brute force, held-out quality."""

import random

import pytest
from llm.helpers import SF, empty_documents, odd_documents, write_tables

from riskloom.llm import queries, stages, toxicity


def brute_segments(scores):
    """Take the best segment (shortest, then first), then those of the rests on both sides."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or (total, -(b - a)) > (best[2], -(best[1] - 1 - best[0]))):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, total = best
    left = brute_segments(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*left, best, *right]


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1.5, 1, 2.25, 4.125]) + rng.random() / 64 for _ in range(rng.randint(0, 25))]
        got, want = sorted(toxicity.segments(scores)), sorted(brute_segments(scores))
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_segments_take_linear_time():
    n = 400_000
    falling = [1.0 if k % 2 else -1.5 for k in range(n)]
    assert len(toxicity.segments(falling)) == n // 2


def test_held_out_quality(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, SF).collect()
    assert len(rows) == 1000
    assert all(r.held_out == toxicity.held_out_id(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
               for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a, b) for a, y in held if y for b, z in held if not z]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert auc > 0.75  # the sample has some 35 toxic texts; see the README for larger tables


def toy(spark):
    rng = random.Random(2)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    docs, labels = [], []
    for k in range(800):
        words = [rng.choice(plain) for _ in range(60)]
        bad = k % 8 == 0
        if bad:
            at = rng.randint(0, 50)
            words[at:at + 3] = ["vile", "vilest", "nasty"]
        docs.append((k, " ".join(words)))
        labels.append((k, 0, int(bad)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_passages_and_stage(spark, tmp_path):
    docs, labels = toy(spark)
    model = toxicity.learn(docs, labels)
    assert "vile" in model.odds and "alpha" not in model.odds
    text = "alpha beta gamma vile nasty vilest delta omega " * 1
    (first, last, score, chance), = model.passages(text)
    assert (first, last) == (3, 6) and score > 0 and chance < 0.01
    assert model.score("alpha beta " * 50) < 0.05 < 0.5 < model.score(text)
    got = docs.select(toxicity.passages_column(model, "text").alias("p")).filter("size(p) > 0").count()
    assert got == 100
    d = write_tables(spark, tmp_path, labels=labels)
    assert stages.drop_toxic(spark, docs, d).count() == 700


def test_bounded_sample_and_model_text(spark):
    docs, labels = toy(spark)
    model = toxicity.learn(docs, labels, sample=200)
    again = toxicity.Model.from_json(model.to_json())
    assert again.score("vile vilest nasty words") == model.score("vile vilest nasty words") > 0.5


def test_odd_and_empty(spark, tmp_path):
    odd = odd_documents(spark)
    _, labels = toy(spark)
    no_labels = labels.limit(0)
    d = write_tables(spark, tmp_path / "a", documents=odd, labels=labels.unionByName(
        spark.createDataFrame([(None, 0, 1), (1, None, None), (2, 0, 1), (2, 0, 0)], labels.schema)))
    assert queries.op2_toxicity(spark, d).count() == odd.count()
    kept = stages.drop_toxic(spark, odd, d)
    assert kept.columns == odd.columns
    d = write_tables(spark, tmp_path / "b", documents=empty_documents(spark), labels=no_labels)
    assert queries.op2_toxicity(spark, d).count() == 0
    d = write_tables(spark, tmp_path / "c", documents=odd, labels=no_labels)
    assert {r.score < 0.3 for r in queries.op2_toxicity(spark, d).collect()} == {True}


def test_only_forms_that_can_be_evidence_are_counted(spark, monkeypatch):
    """The count over all texts keeps no form that the sample's texts of label 1 do not have."""
    docs, labels = toy(spark)
    seen = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: (seen.append(df), collect(df))[1])
    model = toxicity.learn(docs, labels)
    assert model.odds
    plans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1] for df in seen]
    plan = next(p for p in plans if "odds" in p)
    counted = plan[plan.index("partial_count"):]  # below the count of texts by form
    assert counted.index("BroadcastHashJoin") < counted.index("Generate")


def test_forms_of_all_texts_are_found_outside_of_sql_arrays(spark, monkeypatch):
    """The count over all texts builds no arrays of words and stems in SQL; a text has each form once."""
    docs, labels = toy(spark)
    seen = []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: (seen.append(df), collect(df))[1])
    assert toxicity.learn(docs, labels).odds
    plan = next(p for p in (df._jdf.queryExecution().toString() for df in seen) if "odds" in p)
    assert "regexp_extract_all" not in plan and "array_distinct" not in plan
    finder = toxicity.Finder(["vile", "vile*", "viles*", "é", "élan*", "abcd", "abcd*"])
    names = ["vile", "vile*", "viles*", "é", "élan*", "abcd", "abcd*"]
    for text, want in (("vile vile", {"vile"}), ("vilest viles, vile9x", {"vile", "vile*", "viles*"}), ("", set()), ("9 \x1f", set()),
                       ("é élan élans", {"é", "élan*"}), ("abcd_abcde", {"abcd", "abcd*"}), ("²abcd", {"abcd"})):
        got = finder.of(text)
        assert {names[k] for k in got} == want and len(got) == len(want)


def test_words_of_ascii_texts_are_as_of_others():
    text = "".join(map(chr, range(128))) + " It's 9 a_b\tC-d "
    assert toxicity.words_of(text) == toxicity._WORD.findall(text.lower())
