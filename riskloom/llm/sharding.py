"""Sharding by longest-processing-time scheduling (operator 4).

Method: rows with equal texts form a group that must stay together.  Groups,
largest first, go to the least-loaded shard through a heap (LPT).  One heap
over all groups would be one task, so the schedule has two levels, both LPT:

1. groups are dealt over buckets by a hash of the text; in each bucket a task
   streams its groups, largest first, into ``FINE`` bins for each shard;
2. the bins of all buckets, a number that depends on buckets and shards but
   not on rows, go to the shards, largest first, through a heap.

The bins are about equal, and so many that the last ones even out what the
large ones left: shards differ by less than the smallest bins unless a
single group is larger than a shard's share (it cannot be split).

Texts are read once and never shuffled: what moves is a digest, a size and an
id.  A hot group is one row of the group table, counted map-side; where its
many rows meet that row again, the join is one Spark splits when it is skewed.
Slots are counted in ``parts`` for each shard dealt by a hash of the id and
the row's number, so no task ranks a whole shard.

Defined results: a null text is the empty text (one group); repeated rows get
slots of their own in the shard of their group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, ready, same

#: Bins for each shard and bucket.
FINE = 4
#: Bytes a row has besides its text.
ROW_BYTES = 16


def schedule(loads: np.ndarray, shards: int) -> np.ndarray:
    """LPT: the shard of each load (largest first, equal ones as given; least-loaded shard, lowest number first)."""
    heap = [(0, s) for s in range(shards)]
    out = np.empty(len(loads), dtype=np.int64)
    for k in np.argsort(-loads, kind="stable"):
        load, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (load + int(loads[k]), s))
    return out


def _deal(bins: int):
    """Partitions sorted by bucket and falling size -> the bin of each group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, heap = None, []
        for df in batches:
            out = np.empty(len(df), dtype=np.int32)
            for k, (b, size) in enumerate(zip(df["bucket"], df["bytes"], strict=True)):
                if b != bucket:
                    bucket, heap = b, [(0, s) for s in range(bins)]
                load, s = heap[0]
                heapq.heapreplace(heap, (load + int(size), s))
                out[k] = s
            df["bin"] = out
            yield df
    return run


def assign(df: DataFrame, shards: int, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = ready(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    size = F.octet_length(body).cast("long") + ROW_BYTES
    n = partitions(spark)
    rows = keep(df.select(F.col(f"`{id_column}`").alias("doc_id"), size.alias("size"),
                          F.crc32(body).alias("text_crc32"), F.md5(body).alias("digest"),
                          F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.monotonically_increasing_id()), F.lit(n))
                          .cast("int").alias("part")), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")
    dealt = (groups.withColumn("bucket", bucket).repartition(n, "bucket")
             .sortWithinPartitions("bucket", F.desc("bytes"), "digest")
             .mapInPandas(_deal(shards * FINE), "digest string, bytes long, bucket int, bin int"))
    dealt = keep(dealt, "shard-groups")
    bins = dealt.groupBy("bucket", "bin").agg(F.sum("bytes").alias("bytes"))
    # as many rows as buckets x shards x FINE, whatever the input
    loads = bins.toPandas().sort_values(["bucket", "bin"], ignore_index=True)
    loads["shard"] = schedule(loads["bytes"].to_numpy(), shards).astype("int32")
    plan = spark.createDataFrame(loads[["bucket", "bin", "shard"]], "bucket int, bin int, shard int")
    where = dealt.join(plan, ["bucket", "bin"]).select("digest", "shard")
    return _with_slots(rows.join(where, "digest"))


def _with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard: the rows of the parts before, and the place in the own part."""
    in_order = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(in_order), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "digest")
    numbered = placed.withColumn("at", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))


def spread_of(assigned: DataFrame) -> DataFrame:
    """Rows, bytes and slots of each shard."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"),
                                         F.max("slot").alias("last_slot"))


def write_shards(df: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write the rows of ``df`` (unique ids) as one Parquet folder for each shard."""
    at: Column = same(F.col(f"`{id_column}`"), F.col("_id"))
    where = assigned.select(F.col("doc_id").alias("_id"), "shard", "slot")
    df.join(where, at).drop("_id").write.partitionBy("shard").parquet(path)
