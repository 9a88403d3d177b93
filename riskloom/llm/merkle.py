"""Merkle manifest of a table, with a proof for every row (operator 11).

Every row is a leaf: the SHA-256 of its columns, each as its length in bytes,
a colon and the value, a null as a dash.  The leaves of a group, by ascending
id, are the lowest level of its tree; two neighbours become the digest of their
joined hex digests, and a last one without a neighbour the digest of its own.
The groups' subroots, ordered by group (null first, bytewise), form one more tree.

Method: Octopus multiproof.  Each leaf partition (2 ** ``LEVELS`` consecutive
leaves of a tree) lists the coordinates (level, index) of the nodes that the proofs of
all its leaves need and its own leaves do not give, level by level and each one
once.  These are fetched in one join with the table of nodes.  The partition then
derives the interior nodes that its leaves share, once, and expands the
individual proofs from them.

How the work is dealt out:

1. Only digests leave the first pass; texts are never shuffled.
2. Positions: the digests are range-partitioned by (group, id, leaf) and written,
   so that a group may hold any share of the rows; a row's position is its place
   in its partition plus the rows of its group in earlier partitions, counted once
   for each partition and group.  Equal rows fall on any side of a border.
3. Leaf partitions are rows of 2 ** ``LEVELS`` digests.  Their top nodes are grouped
   again by as many, and so on: log2(rows) / ``LEVELS`` small rounds.
4. A node near the root is asked for by many leaf partitions.  Nodes and requests
   carry the partition's number, without its last ``FAN_BITS`` bits, as a salt, and a node is there once
   for each salt below its sibling, so a key of the join has a bounded number of requests.

Defined results: rows of equal id are ordered by leaf; equal rows have
neighbouring places and proofs of their own; a null id comes first; the values
of a null, an empty text and a dash differ (``-``, ``0:`` and ``1:-``).  A tree
of one leaf is that leaf, its proof the digest of no text.  Where nothing is
claimed the row's own leaf is folded.  Of an empty table there is no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, ready, same

#: Levels below the top of a leaf partition, which has two to their power leaves.
LEVELS = 10
#: Leaf partitions that ask for a node under one key, at most, as a power of two.
FAN_BITS = 12
_PATH = "array<struct<left:string,right:string>>"


# ---- trees ----

def digest(*texts: str) -> str:
    """Lowercase hex SHA-256 of the joined texts."""
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above n leaves."""
    return (n - 1).bit_length()


def above(nodes: Sequence[str]) -> list[str]:
    """The level above consecutive nodes that begin at an even index."""
    return [digest(*nodes[k:k + 2]) for k in range(0, len(nodes), 2)]


def missing(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """Coordinates of the nodes that proofs of the ``known`` ones of n leaves need beside these leaves."""
    out, here, level = [], set(known), 0
    while n > 1:
        out += [(level, k ^ 1) for k in sorted(here) if k ^ 1 < n and k ^ 1 not in here]
        here, n, level = {k >> 1 for k in here}, (n + 1) >> 1, level + 1
    return out


def interiors(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """For each level but the last the nodes that are known there: fetched, or derived from those below."""
    levels, own, level = [], dict(leaves), 0
    while n > 1:
        here = own | {k: d for (at, k), d in fetched.items() if at == level}
        levels.append(here)
        own = {p: digest(here[2 * p], here[2 * p + 1] if 2 * p + 1 < n else "") for p in {k >> 1 for k in own}}
        n, level = (n + 1) >> 1, level + 1
    return levels


def path(levels: list[dict[int, str]], k: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf and of each node above it, up to the root ("" for nothing)."""
    out = []
    for here in levels:
        other = here.get(k ^ 1, "")
        out.append((other, "") if k & 1 else ("", other))
        k >>= 1
    return out


def fold(leaf: str, steps: Iterable[tuple[str, str]]) -> str:
    for left, right in steps:
        leaf = digest(left, leaf, right)
    return leaf


# ---- Spark ----

def leaf_column(columns: Sequence[Column]) -> Column:
    """The leaf of a row: each value with its length in bytes, null as a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` written in the order of key and ``order``, with their ``place``; and of each (key, part) of
    them the first place, the rows of the key ``before`` that part, and the rows ``n`` of the key."""
    n = partitions(rows.sparkSession)
    by = [key, *order, "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = keep(dealt.drop("tie").withColumn("place", F.monotonically_increasing_id()), "merkle-placed")
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 33))
    pieces = placed.groupBy(key, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_key = Window.partitionBy(key)
    return placed, pieces.select(
        F.col(key).alias("of"), F.col("part").alias("at"), "first",
        (F.sum("rows").over(of_key.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(of_key).alias("n"))


def _positions(placed: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """``placed`` with the columns of its piece and its ``position`` among the rows of its key, from 0."""
    met = placed.join(pieces, same(F.col(key), F.col("of")) & (F.col("part") == F.col("at")))
    return met.withColumn("position", F.col("before") + F.col("place") - F.col("first"))


def _blocks(rows: DataFrame, bits: int, *carried: str) -> DataFrame:
    """A row for each leaf partition of (tree, n, position, leaf and the carried columns): arrays in the order of position."""
    block = F.shiftright("position", bits).alias("block")
    each = F.sort_array(F.collect_list(F.struct("position", "leaf", *carried))).alias("each")
    grouped = rows.groupBy("tree", block).agg(F.max("n").alias("n"), each)
    return grouped.select("tree", "block", "n", *[F.col("each")[c].alias(c) for c in ("leaf", *carried)])


def _rows(columns: Sequence[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns of each row, one after another, lists as Arrow arrays."""
    for b in batches:
        taken = [b.column(c) for c in columns]
        for k in range(b.num_rows):
            yield tuple(c[k].values if pa.types.is_list(c.type) else c[k].as_py() for c in taken)


def _grown(level: int, bits: int):
    """Folds groups of nodes of ``level`` up to the top of the group or the root; gives the nodes above it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, n, leaf in _rows(("tree", "block", "n", "leaf"), batches):
            here, out = leaf.to_pylist(), []
            if level == 0 and n == 1:
                out.append((0, 0, here[0]))
            for up in range(1, min(bits, depth(n) - level) + 1):
                here = above(here)
                out += [(level + up, (block << (bits - up)) + k, d) for k, d in enumerate(here)]
            if level == 0:
                out = out[-1:]  # below the top of a leaf partition no other one asks
            levels, indexes, digests = zip(*out, strict=True)
            yield pa.record_batch({"tree": pa.array([tree] * len(out), pa.int64()), "n": pa.array([n] * len(out), pa.int64()),
                                   "level": pa.array(levels, pa.int32()), "index": pa.array(indexes, pa.int64()),
                                   "digest": pa.array(digests, pa.string())})
    return run


def _nodes(blocks: DataFrame, bits: int) -> DataFrame:
    """(tree, n, level, index, digest): the tops of the leaf partitions and all nodes above them, the root last."""
    schema = "tree long, n long, level int, index long, digest string"
    nodes = keep(blocks.select("tree", "block", "n", "leaf").mapInArrow(_grown(0, bits), schema), "merkle-nodes")
    largest = blocks.agg(F.max("n")).first()[0] or 0
    tops, level = nodes, bits
    while largest > 1 << level:
        group = F.shiftright("index", bits).alias("block")
        each = F.sort_array(F.collect_list(F.struct("index", "digest")))["digest"].alias("leaf")
        upper = tops.filter((F.col("level") == level) & (F.col("n") > 1 << level)).groupBy("tree", group).agg(F.max("n").alias("n"), each)
        tops = keep(upper.mapInArrow(_grown(level, bits), schema), "merkle-nodes")
        nodes, level = nodes.unionByName(tops), level + bits
    return nodes


def _asked(bits: int):
    """The coordinates that each leaf partition lacks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, n in _rows(("tree", "block", "n"), batches):
            out = missing(range(block << bits, min((block + 1) << bits, n)), n)
            yield pa.record_batch({
                "tree": pa.array([tree] * len(out), pa.int64()), "block": pa.array([block] * len(out), pa.int64()),
                "level": pa.array([a for a, _ in out], pa.int32()), "index": pa.array([b for _, b in out], pa.int64())})
    return run


def _fetched(blocks: DataFrame, nodes: DataFrame, bits: int, fan: int) -> DataFrame:
    """(tree, block, fetched): the nodes that each leaf partition asked for."""
    asked = blocks.select("tree", "block", "n").mapInArrow(_asked(bits), "tree long, block long, level int, index long")
    asked = asked.withColumn("salt", F.shiftright("block", fan))
    # the leaf partitions below a node's sibling ask for it
    last = F.shiftright(F.col("n") - 1, bits)
    first = F.expr(f"shiftleft(index ^ 1L, level - {bits})")
    end = F.expr(f"shiftleft((index ^ 1L) + 1L, level - {bits}) - 1L")
    salts = F.sequence(F.shiftright(first, fan), F.shiftright(F.least(end, last), fan))
    asked_for = nodes.filter((F.col("level") >= bits) & (first <= last))
    salted = asked_for.select("tree", "level", "index", "digest", F.explode(salts).alias("salt"))
    met = asked.join(salted, ["tree", "level", "index", "salt"])
    return met.groupBy("tree", "block").agg(F.collect_list(F.struct("level", "index", "digest")).alias("fetched"))


def _levels(first: int, n: int, leaves: list[str], fetched) -> list[dict[int, str]]:
    got = {} if fetched is None else {(f["level"], f["index"]): f["digest"] for f in fetched.to_pylist()}
    return interiors({first + k: d for k, d in enumerate(leaves)}, got, n)


def _steps(steps: list[list[tuple[str, str]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.array([[{"left": a, "right": b} for a, b in s] for s in steps], kind)


def _paths(bits: int):
    """(of, path) of the members of the tree over the trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, n, leaf, members, fetched in _rows(("block", "n", "leaf", "member", "fetched"), batches):
            first = block << bits
            levels = _levels(first, n, leaf.to_pylist(), fetched)
            yield pa.record_batch({"of": members, "path": _steps([path(levels, first + k) for k in range(len(leaf))])})
    return run


def _expanded(bits: int, with_path: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "n", "id", "leaf", "claim", "fetched", "subroot", "root", "path")
        for block, n, ids, leaf, claim, fetched, subroot, root, tail in _rows(names, batches):
            first, leaves, claims = block << bits, leaf.to_pylist(), claim.to_pylist()
            levels = _levels(first, n, leaves, fetched)
            upper = [(s["left"], s["right"]) for s in tail.to_pylist()]
            steps = [path(levels, first + k) + upper for k in range(len(leaves))]
            folded = [fold(c or own, s) for c, own, s in zip(claims, leaves, steps, strict=True)]
            out = {"id": ids, "leaf": leaf, "subroot": pa.array([subroot] * len(leaves), pa.string()),
                   "root": pa.array([root] * len(leaves), pa.string()),
                   "proof_sha256": pa.array([digest(*[a + b for a, b in s]) for s in steps], pa.string()),
                   "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())}
            if with_path:
                out["path"] = _steps(steps)
            yield pa.record_batch(out)
    return run


def prove(docs: DataFrame, columns: Sequence[str], id_column: str = "doc_id", group: str = "lang",
          where: Column | None = None, claimed: dict[str, Column] | None = None, with_path: bool = False,
          bits: int = LEVELS, fan: int = FAN_BITS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified (and ``path``) of every row.

    Rows for which ``where`` holds claim other values (``claimed``: column -> value); their claimed leaf is
    folded with the proof of the true one, all others fold their own leaf.
    """
    spark = ready(docs.sparkSession)
    named = {c: F.col(f"`{c}`") for c in columns}
    claim = F.lit(None).cast("string")
    if where is not None:
        claim = F.when(where, leaf_column(list((named | (claimed or {})).values())))
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{group}`").cast("string").alias("grp"),
                         leaf_column(list(named.values())).alias("leaf"), claim.alias("claim"))
    placed, pieces = _placed(keep(source, "merkle-leaves"), "grp", ["id", "leaf"])
    pieces = keep(pieces, "merkle-pieces")
    # the trees, in the order of their groups
    groups = pieces.groupBy("of").agg(F.max("n").alias("leaves")).withColumn("all", F.lit(0))
    of_all = _positions(*_placed(groups.withColumnRenamed("of", "grp"), "all", ["grp"]), "all")
    trees = keep(of_all.select(F.col("grp").alias("named"), F.col("position").alias("tree"), "leaves", "n"), "merkle-trees")
    pieces = pieces.join(trees.select("named", "tree"), same(F.col("of"), F.col("named")))
    rows = _positions(placed, pieces, "grp")
    blocks = keep(_blocks(rows, bits, "id", "claim"), "merkle-blocks")
    nodes = _nodes(blocks, bits)
    subroots = keep(nodes.filter(_is_root()).select(F.col("tree").alias("member"), F.col("digest").alias("leaf")), "merkle-subroots")
    # the tree over them
    members = subroots.join(trees, F.col("member") == F.col("tree")).select(
        F.lit(0).cast("long").alias("tree"), F.col("member").alias("position"), "n", "leaf", "member")
    top = keep(_blocks(members, bits, "member"), "merkle-top")
    top_nodes = _nodes(top, bits)
    root = top_nodes.filter(_is_root()).select("digest").first()  # one digest
    paths = top.join(_fetched(top, top_nodes, bits, fan), ["tree", "block"], "left").mapInArrow(_paths(bits), f"of long, path {_PATH}")
    ends = (subroots.join(paths, F.col("member") == F.col("of")).join(trees.select("tree", "leaves"), F.col("member") == F.col("tree"))
            .select(F.col("member").alias("tree"), F.col("leaf").alias("subroot"), F.lit(root and root[0]).alias("root"), "path",
                    F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("leaves") - 1, bits + fan))).alias("salt")))
    # what a leaf partition gets from elsewhere: the nodes it lacks, and the way from its subroot up
    given = (blocks.select("tree", "block", F.shiftright("block", fan).alias("salt"))
             .join(_fetched(blocks, nodes, bits, fan), ["tree", "block"], "left").join(ends, ["tree", "salt"]).drop("salt"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
              + (f", path {_PATH}" if with_path else ""))
    return blocks.join(given, ["tree", "block"]).mapInArrow(_expanded(bits, with_path), schema).withColumnRenamed("id", id_column)


def _is_root() -> Column:
    """Whether a node is alone on its level."""
    return F.expr("shiftright(n + shiftleft(1L, level) - 1L, level) = 1L")
