"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, parallelism, partitions

#: Links of a task in a round; a round has as many tasks as that takes, one per core at least.
TASK_LINKS = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node of ``links``.

    Alternates the large-star and small-star steps (each node links its larger, then its smaller
    neighbours to the least node it sees), which ends after about log(nodes) rounds.  Each round is
    two groupings and joins on the node, written to the shared folder; a hub's many links are rows,
    never a list, so Spark can split them.  The rounds end when every node that has a smaller
    neighbour has one only and no larger one.  Links whose ends are equal only name a node; null ends
    are left out.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    given = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-links")
    edges = given.filter("u <> v")
    count, done = _state(edges)
    while not done:
        edges = keep(_round(edges, count), "component-links")
        count, done = _state(edges, count)
    nodes = given.select("u").union(given.select("v")).distinct()
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), nodes["u"] == F.col("node"),
                      "left").select(nodes["u"].alias("node"), F.coalesce("root", nodes["u"]).alias("root"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _few(df: DataFrame, count: int | None) -> DataFrame:
    """``df``, whose rows follow from ``count`` links, in no more tasks than these need."""
    n = partitions(df.sparkSession)
    tasks = n if count is None else max(parallelism(df.sparkSession), -(-count // TASK_LINKS))
    return df.coalesce(tasks) if tasks < n else df


def _round(edges: DataFrame, count: int) -> DataFrame:
    """One large-star and one small-star step over ``count`` links."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = _few(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v"), count)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = _few(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))), count)
    return _few(small.distinct(), count)


def _state(edges: DataFrame, count: int | None = None) -> tuple[int, bool]:
    """Number of links (``count``: about as many), and whether all of them lead to the least node of their component."""
    ends = _both(edges).groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("down"),
                                         F.count_if(F.col("v") > F.col("u")).alias("up"))
    r = _few(ends, count).agg(F.sum("down"), F.count_if(F.expr("down > 1 OR down = 1 AND up > 0"))).first()
    return r[0] or 0, not r[1]
