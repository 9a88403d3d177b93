"""Near copies against all pairs."""

import random
import re

import numpy as np
import pytest
from llm.helpers import SF, empty_documents, odd_documents, write_tables

from riskloom.llm import components, jaccard, queries, stages


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """(id, n_shingles, component) of (id, text) rows."""
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(range(len(docs)), key=lambda k: len(sets[k]))
    for p, a in enumerate(order):
        for b in order[p + 1:]:
            if 10 * len(sets[a]) < 9 * len(sets[b]):
                break
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 90 * (len(sets[a]) + len(sets[b]) - inter):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(docs)), key=str)


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op8_jaccard_join(spark, SF).collect()), key=str)
    assert got == brute(docs)
    assert sum(i != c for i, _, c in got) > 20


def chains(seed, n=260):
    """Groups of texts a few edits apart, of all sizes, near the threshold on both sides."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(3000)]
    docs = []
    while len(docs) < n:
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 11, 12, 13, 20, 33, 60, 120]))]
        for _ in range(rng.randint(1, 9)):
            docs.append((rng.randint(0, 10**9), " ".join(text)))
            for _ in range(rng.randint(0, 1 + len(text) // 45)):
                k = rng.randrange(len(text))
                text = text[:k] + ([rng.choice(words)] if rng.random() < 0.7 else []) + text[k + rng.randint(0, 1):]
                text = text or ["v"]
    return docs


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 2), (3, 1)])
def test_chains(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    docs = chains(seed)
    out = jaccard.near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(docs)


def test_linked_sets_state_a_common_key():
    """Whatever differs within the bound, a segment key is shared."""
    rng, steps = np.random.default_rng(11), jaccard.Steps()
    for _ in range(4000):
        n = int(rng.integers(1, 80)) if rng.random() < 0.8 else int(rng.integers(80, 3000))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(rng.integers(0, max(1, n // 9) + 1))
        more = int(rng.integers(0, max(1, n // 9) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**63, more).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if not inter or not jaccard.linked(inter, len(a), len(b)):
            continue
        assert set(jaccard.stated_keys(a, steps).tolist()) & set(jaccard.stated_keys(b, steps).tolist())


def test_trie_finds_every_link():
    rng = np.random.default_rng(12)
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        sets = []
        for _ in range(25):
            keep = rng.random(len(base)) > rng.choice([0, 0.02, 0.05, 0.1])
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**64, rng.integers(0, 4), dtype=np.uint64)])))
        lists = [s.tolist() for s in sets]
        trie = jaccard.build(lists, list(range(25)))
        for x in range(25):
            got = set(jaccard.search(trie, frozenset(lists[x]), lists[x], lambda m: False))
            want = {y for y in range(25) if jaccard.linked(len(set(lists[x]) & set(lists[y])), len(lists[x]), len(lists[y]))}
            assert got == want


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)]
    links += [(5000, 5000), (None, 3)] + [(2000, 2001 + k) for k in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stage_keeps_one_of_each(spark):
    docs = chains(8, 120) + [(5, "same text here and there"), (5, "same text here and there"), (6, ""), (6, ""), (7, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, root string")
    kept = stages.keep_one_of_near_copies(spark, df, "")
    assert kept.columns == df.columns
    want = brute(docs)
    groups = {c for _, n, c in want if n}
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*groups, 6, 6, 7])


def test_odd_and_empty(spark, tmp_path):
    odd = odd_documents(spark)
    d = write_tables(spark, tmp_path, documents=odd)
    got = sorted((tuple(r) for r in queries.op8_jaccard_join(spark, d).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got == want
    kept = stages.keep_one_of_near_copies(spark, odd, d)
    assert kept.columns == odd.columns and kept.filter("text LIKE 'the quick%'").count() == 1
    assert jaccard.near_copies(empty_documents(spark)).count() == 0
    assert stages.keep_one_of_near_copies(spark, empty_documents(spark), d).count() == 0


def test_cells_compare_by_bits(monkeypatch):
    """A cell's links are those of brute force, and no node's hashes are compared as Python sets."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(150) > rng.choice([0, 0.03, 0.08])],
                                      rng.integers(0, 2**64, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 5, 400)] + [np.empty(0, dtype=np.uint64)]
    seen = []
    node = jaccard.Node.__init__
    monkeypatch.setattr(jaccard.Node, "__init__", lambda self, *a: (node(self, *a), seen.append(type(self.hashes)))[0])

    def groups(links):
        forest = jaccard.Forest(len(sets))
        for a, b in links:
            forest.join(a, b)
        return [forest.find(k) for k in range(len(sets))]

    everything = list(range(len(sets)))
    for left, right in ((everything, everything), (everything[::2], everything[1::2])):
        want = [(a, b) for a in left for b in right if a != b and len(sets[a]) and jaccard.linked(
            len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))]
        assert groups(jaccard.join_cell(sets, left, right)) == groups(want)
    assert set(seen) == {int}
    assert jaccard.join_cell([], [], []) == []


def test_rounds_of_few_links_have_few_tasks(spark, monkeypatch):
    """The tables of a round over few links are written by few tasks, and stars end the rounds at once."""
    links = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(1000 + k, 1000) for k in range(50)], "a long, b long")
    files, keep, before = [], components.keep, spark.conf.get("spark.sql.shuffle.partitions")

    def kept(df, name):
        df = keep(df, name)
        files.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(components, "keep", kept)
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.root for r in components.components(links).collect()}
        assert got == {k: 0 for k in range(10)} | {1000 + k: 1000 for k in range(50)}
        assert len(files) > 1 and max(files[1:]) <= components.parallelism(spark) < files[0]
        files.clear()
        components.components(links.filter("a >= 1000"))
        assert len(files) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
