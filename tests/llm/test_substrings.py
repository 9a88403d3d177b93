"""Repeated passages: chunk rules, and passages planted in other texts."""

import random

import numpy as np
from llm.helpers import SF, empty_documents, odd_documents, write_tables
from pyspark.sql import functions as F

from riskloom.llm import queries, substrings


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_hash_by_definition():
    data = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    got = substrings.gear_hash(data)
    for i in range(len(data)):
        want = 0
        for j in range(min(i + 1, substrings.WINDOW)):
            want += int(substrings.GEAR[data[i - j]]) << j
        assert int(got[i]) == want % 2**32


def test_cuts_by_definition():
    rng = random.Random(2)
    data = prose(rng, 300).encode()
    h = substrings.gear_hash(np.frombuffer(data, dtype=np.uint8)).tolist()
    r, n = substrings.RADIUS, len(data)
    plain = [k + 1 for k in range(r, n - r - 1) if all(h[k] < x for x in h[k - r:k] + h[k + 1:k + r + 1])]
    got = substrings.cuts(data).tolist()
    assert got[-1] == n and set(plain) <= set(got)
    assert all(b - a <= substrings.LONGEST for a, b in zip([0, *got], got, strict=False))


def test_insertions_move_no_far_cut():
    rng = random.Random(3)
    text = prose(rng, 400).encode()
    at = len(text) // 2
    moved = text[:at] + b"inserted words " + text[at:]
    a, b = substrings.cuts(text), substrings.cuts(moved)
    far = substrings.RADIUS + substrings.WINDOW + 1
    assert [x for x in a if x < at - far] == [x for x in b if x < at - far]
    assert [x + 15 for x in a if x > at + far] == [x for x in b if x > at + 15 + far]


def test_planted_passages(spark):
    rng = random.Random(4)
    docs = [(k, prose(rng, rng.randint(80, 400))) for k in range(300)]
    planted, places = {}, rng.sample(range(300), 80)
    for p in range(40):
        passage = prose(rng, 51 + p % 20)
        for k in places[2 * p:2 * p + 2]:
            t = docs[k][1]
            at = t.index(" ", rng.randint(0, len(t) // 2))
            docs[k] = (k, f"{t[:at]} {passage} {t[at + 1:]}")
            planted.setdefault(p, []).append(k)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.repeated_passages(df).collect()
    caught = {(r.doc_id, i) for r in found for i in r.first_doc_ids}
    for pair in planted.values():
        a, b = sorted(pair)
        assert (b, a) in caught
    clean = set(range(300)) - {k for v in planted.values() for k in v}
    assert not clean & ({r.doc_id for r in found} | {i for r in found for i in r.first_doc_ids})


def test_query_finds_copies_and_only_repeats(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_substring_dedup(spark, SF).collect()
    caught = {r.doc_id for r in rows}
    first = {}
    for i in sorted(texts):
        if texts[i] in first and len(texts[i].split()) >= 60:
            assert i in caught
        first.setdefault(texts[i], i)
    for r in rows:  # every passage really stands in the documents that keep it
        data = texts[r.doc_id].encode()[r.start:r.end]
        assert len(data.decode("utf-8", "ignore").split()) >= substrings.LEAST_WORDS - 1
        if len(r.first_doc_ids) == 1 and r.first_doc_ids[0] != r.doc_id:
            head = data[:substrings.RADIUS].decode("utf-8", "ignore")
            assert head in texts[r.first_doc_ids[0]]


def test_removal(spark):
    rng = random.Random(5)
    passage = prose(rng, 120)
    docs = [(1, f"{prose(rng, 90)} é {passage} 🙂 {prose(rng, 90)}"), (2, f"{prose(rng, 95)} {passage} {prose(rng, 40)}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.repeated_passages(df)
    got = {r.doc_id: r.text for r in substrings.without_passages(df, found).collect()}
    assert got[1] == docs[0][1] and len(got[2]) < len(docs[1][1]) - len(passage) / 2
    assert docs[1][1].startswith(got[2][:300]) and docs[1][1].endswith(got[2][-100:])


def test_odd_and_empty(spark, tmp_path):
    odd = odd_documents(spark)
    rows = queries.op1_substring_dedup(spark, write_tables(spark, tmp_path, documents=odd)).collect()
    assert {8, 9, 11} >= {r.doc_id for r in rows}  # the long ones repeat themselves; short copies are under 25 words
    found = substrings.repeated_passages(odd)
    out = substrings.without_passages(odd, found)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.filter(F.col("doc_id") == 10).first().text == odd.filter("doc_id = 10").first().text
    assert substrings.repeated_passages(empty_documents(spark)).count() == 0


def test_periodic_runs_are_cut_alike_in_any_context():
    rng = random.Random(31)
    for period, size in (("thatin ", 400), ("thatin ", 1000), ("rewh ", 300), ("spam eggs ", 5000), ("x ", 200)):
        body = (period * (size // len(period) + 1))[:size]
        for _ in range(20):
            held = set(substrings.chunk_rows(f"{prose(rng, 90)} {body}{prose(rng, 90)}")[3])
            _, _, words, digests = substrings.chunk_rows(f"{prose(rng, 70)}. {body}{prose(rng, 70)}")
            run, most = 0, 0
            for w, d in zip(words.tolist(), digests, strict=True):
                run = run + w if d in held else 0
                most = max(most, run)
            assert most >= substrings.LEAST_WORDS


def test_long_periodic_texts_keep_few_chunks():
    for text in (b"x" * 50_000, b"word " * 30_000, b"ab" * 40_000):
        assert len(substrings.cuts(text)) < len(text) / 60
