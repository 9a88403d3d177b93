"""Sharding: the scheduler against brute force, and the law of the query."""

import heapq
import zlib

import numpy as np
import pytest
from llm.helpers import SF, odd_documents, write_tables

from riskloom.llm import queries, sharding


def test_schedule_is_lpt():
    rng = np.random.default_rng(4)
    loads = rng.integers(1, 1000, 500)
    got = sharding.schedule(loads, 7)
    heap, want = [(0, s) for s in range(7)], {}
    for k in sorted(range(len(loads)), key=lambda k: -loads[k]):
        load, s = heapq.heappop(heap)
        want[k] = s
        heapq.heappush(heap, (load + int(loads[k]), s))
    assert got.tolist() == [want[k] for k in range(len(loads))]


def check(rows, texts_of_size, shards=40):
    by_shard, shard_of_text = {}, {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
        shard_of_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert set(by_shard) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert all(len(v) == 1 for v in shard_of_text.values())  # no two texts here share size and checksum
    return by_shard


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    check(rows, texts)
    load = {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        load[r.shard] = load.get(r.shard, 0) + r.size
    groups = {}
    for r in rows:
        groups.setdefault(texts[r.doc_id], 0)
        groups[texts[r.doc_id]] += r.size
    mean = sum(load.values()) / 40
    assert len(load) == 40
    assert max(load.values()) <= max(1.01 * mean, max(groups.values()))
    assert min(load.values()) >= 0.99 * mean


def test_hot_group_stays_whole(spark):
    rows = [(k, "hot " * 50) for k in range(300)] + [(1000 + k, f"text {k} " * (k % 9 + 1)) for k in range(600)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert len({r.shard for r in got if r.doc_id < 300}) == 1
    check(got, None, 5)
    others = {}
    for r in got:
        if r.doc_id >= 300:
            others[r.shard] = others.get(r.shard, 0) + r.size
    assert max(others.values()) - min(others.values()) <= 0.05 * max(others.values())


def test_odd_and_empty(spark, tmp_path):
    odd = odd_documents(spark)
    got = queries.op4_sharding(spark, write_tables(spark, tmp_path, documents=odd)).collect()
    assert len(got) == odd.count()
    assert sum(r.size == 16 for r in got) == 3
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


@pytest.mark.parametrize("shards", [1, 3])
def test_write(spark, tmp_path, shards):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(10)], "doc_id long, text string")
    sharding.write_shards(df, sharding.assign(df, shards), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 10 and back.select("shard").distinct().count() == shards
