"""Merkle manifest against a tree built row by row."""

import hashlib
import random
import zlib

import pytest
from llm.helpers import SF, empty_documents, odd_documents, write_tables
from pyspark.sql import functions as F

from riskloom.llm import merkle, queries


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Root and, for each leaf, the (left, right) siblings up to it."""
    level, where, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for p, k in zip(paths, where):
            run = level[k // 2 * 2:k // 2 * 2 + 2]
            p.append(("" if k % 2 == 0 else run[0], run[1] if k % 2 == 0 and len(run) == 2 else ""))
        level = [sha(*level[k:k + 2]) for k in range(0, len(level), 2)]
        where = [k // 2 for k in where]
    return level[0], paths


def brute(rows):
    """The query's rows of (doc_id, source, lang, n_chars, text) rows, as a sorted list."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf_of(*r), r))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for v in groups.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = [tree([x[1] for x in groups[g]]) for g in langs]
    root, tops = tree([b[0] for b in built]) if built else (None, [])
    out = []
    for (sub, paths), top, g in zip(built, tops, langs):
        for (i, leaf, r), p in zip(groups[g], paths):
            steps = p + top
            now = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[3] is not None:
                now = leaf_of(*r[:3], r[3] + 1, r[4])
            for a, b in steps:
                now = sha(a, now, b)
            out.append((i, leaf, sub, root, sha(*[a + b for a, b in steps]), now, now == root))
    return sorted(out, key=str)


NAMES = "doc_id long, source string, lang string, n_chars long, text string"


def answer(spark, rows, folder):
    df = spark.createDataFrame(rows, NAMES)
    d = write_tables(spark, folder, documents=df)
    return sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, d).collect()), key=str)


@pytest.mark.parametrize("bits, fan, counts", [(2, 1, (37, 1, 5, 64, 129)), (1, 0, (3, 2, 17)), (10, 12, (1,))])
def test_equals_row_by_row_tree(spark, bits, fan, counts):
    rng, rows = random.Random(5), []
    for k, n in enumerate(counts):
        rows += [(rng.randint(-50, 10**6), "s", [None, "b", "", "ä", "a"][k], rng.randint(0, 9), f"t{j}é") for j in range(n)]
    rng.shuffle(rows)
    got = merkle.prove(spark.createDataFrame(rows, NAMES), ("doc_id", "source", "lang", "n_chars", "text"), bits=bits, fan=fan,
                       where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, claimed={"n_chars": F.col("n_chars") + 1})
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_query_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_merkle_manifest(spark, SF).collect()), key=str)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


def test_nulls_repeats_and_extremes(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "-", "", None, ""), (7, "a", "x", None, "t"), (7, "a", "x", 2**63 - 1, "t"),
            (7, "a", "x", 3, "t"), (7, "a", "x", 3, "t"), (1, "a" * 100_000, "x", 0, "é🙂" * 50_000)] * 2
    assert answer(spark, rows, tmp_path / "odd") == brute(rows)
    assert answer(spark, [], tmp_path / "empty") == []


def test_paths_and_other_columns(spark):
    docs = odd_documents(spark)
    got = merkle.prove(docs, ("doc_id", "text"), group="root", with_path=True).collect()
    assert len(got) == docs.count() and all(r.verified for r in got)
    for r in got:
        assert merkle.fold(r.leaf, [(s.left, s.right) for s in r.path]) == r.root
    assert merkle.prove(empty_documents(spark), ("doc_id", "text")).count() == 0


def test_one_changed_value_is_seen(spark):
    docs = odd_documents(spark).filter("doc_id IS NOT NULL")
    got = merkle.prove(docs, ("doc_id", "text"), group="root", where=F.col("doc_id") == 6,
                       claimed={"text": F.lit("two")}).collect()
    assert sorted(r.doc_id for r in got if not r.verified) == [6]


def test_multiproof_asks_for_the_least():
    """Every node asked for is needed, and all others can be derived."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 70)
        known = sorted(rng.sample(range(n), rng.randint(1, n)))
        leaves = [sha(str(k)) for k in range(n)]
        nodes, level, at = {}, leaves, 0
        while True:
            nodes |= {(at, k): d for k, d in enumerate(level)}
            if len(level) == 1:
                break
            level, at = merkle.above(level), at + 1
        asked = merkle.missing(known, n)
        assert len(asked) == len(set(asked))
        levels = merkle.interiors({k: leaves[k] for k in known}, {c: nodes[c] for c in asked}, n)
        root, paths = tree(leaves)
        for k in known:
            assert merkle.path(levels, k) == paths[k] and merkle.fold(leaves[k], paths[k]) == root
        derivable = {(0, k) for k in known}
        for a, k in sorted(asked):  # no asked node lies above known leaves
            assert not any(k == j >> a for j in known)
        assert derivable.isdisjoint(asked)
