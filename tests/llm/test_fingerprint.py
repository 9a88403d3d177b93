"""Fingerprints against their definition, one text at a time."""

import hashlib
import random

import pytest
from llm.helpers import SF, TINY, odd_documents, write_tables
from pyspark.sql import functions as F

from riskloom.llm import fingerprint, queries


def edited_texts(docs):
    """doc_id -> edited text, for unique ids."""
    order = sorted(docs, reverse=True)
    out = {}
    for k, i in enumerate(order):
        t, following = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        out[i] = t[:len(t) - half] + following[:half]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in queries.op9_fingerprints(spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_edited_text(rows, texts):
    want = edited_texts(texts)
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()


def test_equal_texts_have_equal_fingerprints(rows, texts):
    by_text, by_print = {}, {}
    for i, r in rows.items():
        by_text.setdefault(texts[i], set()).add(r.fingerprint)
        by_print.setdefault(r.fingerprint, set()).add("\n".join(sorted(p for p in texts[i].split("\n") if p)))
    assert all(len(v) == 1 for v in by_text.values())
    assert all(len(v) == 1 for v in by_print.values())  # only the order of paragraphs may differ


def test_likeness_tells_edits_from_strangers(rows):
    some = [r for r in rows.values() if r.n_chars >= 60]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in some)
    better = sum(r.near_edited > r.near_next for r in some) / len(some)
    assert better > 0.97


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = fingerprint.fingerprints(df, ["k"], {"fp": F.col("text")})
    return [r.fp for r in out.orderBy("k").collect()]


def test_order_independent_and_homomorphic(spark):
    a, b, both, swapped, other = prints(spark, ["one two three four", "five six", "one two three four\nfive six",
                                               "five six\none two three four", "one two three\nfour five six"])
    assert both == swapped and both != other
    df = spark.createDataFrame([(both, a, b)], ["both", "a", "b"])
    kind = "struct<identity:array<bigint>,lanes:array<bigint>,pieces:bigint>"
    df = df.select(*[F.col(c).cast(kind).alias(c) for c in df.columns])
    r = df.select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"),
                  fingerprint.combine(F.col("both"), F.col("b"), -1).alias("rest")).first()
    assert tuple(r["sum"]) == tuple(both) and tuple(r["rest"]) == tuple(a)


def test_lanes_by_definition(spark):
    """Lanes of a text of several blocks of pieces equal sums over its paragraphs."""
    rng = random.Random(3)
    paragraphs = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(1, 9)))
                  for _ in range(40)]
    *parts, whole = prints(spark, [*paragraphs, "\n".join(paragraphs)])
    for name, bits in (("identity", fingerprint.IDENTITY_BITS), ("lanes", fingerprint.LANE_BITS)):
        assert list(whole[name]) == [sum(x) % (1 << bits) for x in zip(*[p[name] for p in parts], strict=True)]
    assert whole["pieces"] == sum(p["pieces"] for p in parts)


def test_odd_one_and_no_rows(spark, tmp_path):
    d = write_tables(spark, tmp_path / "odd", documents=odd_documents(spark))
    got = queries.op9_fingerprints(spark, d).collect()
    assert len(got) == odd_documents(spark).count()
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    one = write_tables(spark, tmp_path / "one", documents=spark.createDataFrame([(7, "abcd")], "doc_id long, text string"))
    r = queries.op9_fingerprints(spark, one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    none = write_tables(spark, tmp_path / "none", documents=spark.createDataFrame([], "doc_id long, text string"))
    assert queries.op9_fingerprints(spark, none).count() == 0


def test_rows_without_id_come_last_by_hash(spark):
    texts = [f"text number {k} of some" for k in range(200)]
    rows = [(None if k % 3 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    hashes = {r.text: r.h for r in df.collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    following = {t: order[(k + 1) % 200][1] for k, (_, t) in enumerate(order)}
    got = fingerprint.with_next(df).filter("sentinel = 0").collect()
    assert len(got) == 200 and all(r.next == following[r.text] for r in got)
    assert len({r.bucket for r in got if r.order is None}) > 10


def test_native(spark):
    plan = queries.op9_fingerprints(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_run_of_three_words_is_a_piece(spark):
    texts = ["a b c d e", "a b", "  a\tb \n\n c d e f ", "", " \n ", "one\ntwo words\nthree words here", "x" * 50_000]
    want = [3, 1, 3, 0, 0, 3, 1]
    assert [p["pieces"] for p in prints(spark, texts)] == want


def test_an_insertion_changes_few_pieces(spark):
    line = " ".join(f"w{k}" for k in range(300))
    a, b = prints(spark, [line, "new " + line])
    kind = "struct<identity:array<bigint>,lanes:array<bigint>,pieces:bigint>"
    df = spark.createDataFrame([(a, b)], ["a", "b"]).select(*[F.col(c).cast(kind).alias(c) for c in "ab"])
    assert df.select(fingerprint.likeness(F.col("a"), F.col("b"))).first()[0] > 0.95


def test_strangers_and_copies_beyond_a_million_words(spark):
    docs = spark.sql("""SELECT id AS doc_id, array_join(transform(sequence(1, 1200000), k -> concat(
        if(id = 3, 'x', if(id = 1, 'a', 'b')), cast(if(id = 3, 1, k) AS string))), ' ') AS text FROM range(1, 4)""")
    got = {r.doc_id: r for r in fingerprint.fingerprint_pairs(docs).collect()}
    assert got[2].near_next < 0.1 and got[3].near_next < 0.1  # no word in common; the last one repeats one word
    assert 0.2 < got[2].near_edited < 0.8  # half of the text stays
