"""The near-copy stage against all pairs: five-word shingles, 0.8 or more."""

import re

import numpy as np
import pytest
from llm.helpers import SF
from llm.test_jaccard import chains

from riskloom.llm import components, jaccard, stages


def kept_ids(docs, words=5, percent=80):
    """Ids that stay of (id, text) rows with unique ids."""
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(range(len(docs)), key=lambda k: len(sets[k]))
    for p, a in enumerate(order):
        for b in order[p + 1:]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def test_two_edits_in_a_hundred_words(spark):
    words = [f"w{k}" for k in range(100)]
    edited = [*words[:30], "x", *words[31:70], "y", *words[71:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.keep_one_of_near_copies(spark, df, "").collect()) == [1, 3]


@pytest.mark.parametrize("seed, block", [(21, 1024), (22, 2)])
def test_stage_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    docs = [(k, t) for k, (_, t) in enumerate(chains(seed, 200))]
    kept = stages.keep_one_of_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    got = sorted(r.doc_id for r in kept.collect())
    assert got == kept_ids(docs) and got != kept_ids(docs, 3, 90)


def test_stage_on_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    got = sorted(r.doc_id for r in stages.keep_one_of_near_copies(spark, df, SF).collect())
    assert got == kept_ids(docs) and len(got) < len(kept_ids(docs, 3, 90))


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_linked_sets_state_a_common_key(percent):
    rng, steps = np.random.default_rng(13), jaccard.Steps(percent)
    for _ in range(2000):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone, more = rng.integers(0, n * (100 - percent) // 100 + 1, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, more).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if inter and jaccard.linked(inter, len(a), len(b), percent):
            assert set(jaccard.stated_keys(a, steps).tolist()) & set(jaccard.stated_keys(b, steps).tolist())


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_keys_left_of_linked_sets_meet(percent):
    """In any order of the keys, two linked sets share one after each left out what it can spare."""
    rng, steps = np.random.default_rng(17), jaccard.Steps(percent)
    for _ in range(1000):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone, more = rng.integers(0, n * (100 - percent) // 100 + 1, 2)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, more).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if not inter or not jaccard.linked(inter, len(a), len(b), percent):
            continue
        (x, spare_x), (y, spare_y) = (jaccard.stated(s, steps) for s in (a, b))
        shared = set(x.tolist()) & set(y.tolist())

        def left(keys, spare):  # the shared keys are the most frequent ones: the worst case
            out = set()
            for bit in (0, 1):
                own = sorted((k for k in keys.tolist() if k & 1 == bit), key=lambda k: (k in shared, k), reverse=True)
                out |= set(own[spare[bit]:])
            return out

        assert left(x, spare_x) & left(y, spare_y)


def test_strangers_do_not_chain(spark):
    """Candidate groups stay as small as groups of near copies: pairs within them are fewer than the texts."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    jaccard.ready(spark)
    rows = jaccard._read_sets(df, 5, 80).filter("digest IS NOT NULL")
    classes = jaccard.keep(jaccard._classes(rows), "t")
    pairs = jaccard.keep(jaccard._candidates(jaccard.keep(rows.filter("keys IS NOT NULL"), "t"), classes), "t")
    sizes = [r["count"] for r in components.components(pairs, "node", "least").groupBy("root").count().collect()]
    assert max(sizes) <= 50  # near copies below the threshold are candidates too
    assert sum(k * k for k in sizes) <= classes.count()
