"""URL rules by a sort-merge range join (operator 3).

Method: a host's labels are reversed (``a.example.net`` -> ``net.example.a.``),
so that a rule's host is a prefix of the keys of its subdomains and the rule
covers one interval of the sorted keys.  URLs and rules are sorted together;
a sweep over the sorted rows keeps a stack of the rules whose interval is
open.  Intervals of prefixes nest, so the stack is popped only at its top,
and the rules on it are exactly those whose host fits.  Of these, the longest
whose path begins the URL's path wins.

The sweep is distributed like a prefix sum: rows are range-partitioned by key
(and, within a key, by path and id, so a hot host spreads over partitions);
the partitions are written; each partition's first key is split into its
label prefixes and equi-joined with the rules to find those that are open
where the partition begins; they join its rows, and each partition is swept on
its own.  Rules are never broadcast or collected.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: then up to ``?``, ``#`` or the end.  Defined results: null
URLs and those without ``://`` have an empty host and path, which no rule
fits; without a fitting rule the verdict is allow; of equally long rules the
one with the longer host wins, then block, then the smaller text; repeated
rows are judged each on their own; rules repeated or of an empty host count
once or not at all; hosts of rules may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, partitions, ready

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule like ``example.net/en/``) pairs as a table of rules."""
    return spark.createDataFrame(rules, "verdict string, rule string")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition, then key, rules before URLs: the rule and verdict of each URL."""
    part, stack = None, []  # of (key, path, rank, rule, verdict)
    for batch in batches:
        won, verdicts = [], []
        columns = [batch.column(c).to_pylist() for c in ("part", "kind", "key", "path", "rule", "verdict")]
        for p, kind, key, path, rule, verdict in zip(*columns, strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind < 1:
                stack.append((key, path, (len(rule), len(key), verdict == BLOCK), rule, verdict))
                continue
            best = None
            for entry in stack if key else ():
                if path.startswith(entry[1]) and (best is None or entry[2] > best[2] or (
                        entry[2] == best[2] and entry[3] < best[3])):
                    best = entry
            won.append(best[3] if best else None)
            verdicts.append(best[4] if best else ALLOW)
        judged = batch.filter(pa.compute.equal(batch.column("kind"), 1)).select(
            [c for c in batch.schema.names if c not in ("part", "kind", "key", "rule", "verdict")])
        yield pa.RecordBatch.from_arrays([*judged.columns, pa.array(won, pa.string()), pa.array(verdicts, pa.string())],
                                         names=[*judged.schema.names, "rule", "verdict"])


def judge(df: DataFrame, rules: DataFrame, url: str = "url", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry`` columns, host, path, rule (null if none fits) and verdict of every row of ``df``.

    ``rules``: verdict (allow or block) and rule (host, then path from the first slash).
    """
    spark = ready(df.sparkSession)
    n = partitions(spark)
    u = F.col(f"`{url}`").cast("string")
    kept_names = [f"c{k}" for k in range(len(carry))]
    nothing = F.lit(None).cast("string")
    urls = df.select(host_key(host_of(u)).alias("key"), F.lit(1).alias("kind"), path_of(u).alias("path"),
                     nothing.alias("rule"), nothing.alias("verdict"), host_of(u).alias("host"),
                     *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept_names, strict=True)])
    host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), _UPPER, _LOWER)
    entries = (rules.select("rule", F.lower("verdict").alias("verdict"), host_key(host).alias("key"),
                            F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("path"), host.alias("h"))
               .filter((F.col("h") != "") & F.col("verdict").isin(ALLOW, BLOCK))
               .select("key", "path", "rule", "verdict").distinct())

    def as_rows(found: DataFrame, kind: int) -> DataFrame:
        return found.withColumn("kind", F.lit(kind))

    tie = F.xxhash64("path", "rule", *kept_names)
    # written, so that the rows of a partition stay together whenever they are read again
    ranged = (urls.unionByName(as_rows(entries, 0), allowMissingColumns=True).withColumn("tie", tie)
              .repartitionByRange(n, "key", "kind", "tie").withColumn("part", F.spark_partition_id()))
    kept = keep(ranged.drop("tie"), "url-ranges")
    longest = entries.agg(F.max(F.length("key"))).first()[0] or 1  # no rule is open on more of a key
    first = kept.groupBy("part").agg(F.min(F.substring("key", 1, longest)).alias("key"))
    labels = F.split("key", r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.concat(
        F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))
    carried = first.select("part", F.explode(prefixes).alias("key")).join(entries, "key")
    swept = (kept.unionByName(as_rows(carried, -1), allowMissingColumns=True)
             .repartition(n, "part").sortWithinPartitions("part", "key", "kind"))
    judged = kept.select(*[c for c in kept.columns if c not in ("part", "kind", "key", "rule", "verdict")],
                         "rule", "verdict").schema
    return swept.select(*kept.columns).mapInArrow(_sweep, judged).select(
        *[F.col(k).alias(c) for c, k in zip(carry, kept_names, strict=True)], "host", "path", "rule", "verdict")
