"""N-gram Jaccard join of whole texts (operator 8).

A text is the set of its distinct shingles of ``words`` words (64-bit hashes);
two texts link when ``100 * |a & b| >= percent * |a | b|``.  The query's rule is
three words and 90; steps, segments and bounds below follow from the two.

Method: prefix-tree join.  Sets, as ascending hashes (one order for all), are
stored in a trie whose chains are joined to one node; for each set the trie is
traversed with a running overlap, shared by all sets below a node, and a
subtree is left as soon as the hashes missing on either side exceed what the
lengths below it allow.

How the work is dealt out:

1. Texts with equal sets fold into one class by a digest of the set.
2. Linked sets of sizes m and n differ in at most (m + n) / 19 hashes (at 90
   percent; (m + n) / 9 at 80).  The hashes are dealt over more *segments* than
   that by value, ``SURPLUS`` times as many more, so two linked sets agree in
   as many whole segments as there are to spare.  Sizes fall into steps; a set
   states the content of its segments for its own step, and for the next one
   if a linked set can be in it: rows of a key and 64 bits of the digest.
   Keys are ordered by how many sets state them.  Each set leaves out as many
   of its most frequent keys as it has segments to spare; the rarest key that
   two linked sets share is then left in both.  Sets that share a left key are
   candidates, linked to the least one.  Texts that have passages in common
   share the same few keys with many others, and these are the ones left out,
   so strangers do not chain into large groups.  A copy's keys are stated once
   for each task that reads copies of it.  A key has a row of a set at most,
   and a set has as many keys as segments, so no key holds a large share.
   A segment that is empty counts as one of the most frequent keys.
3. Connected components of these candidates are joined by tries, each in one
   task if it is small.  A larger one is split by digest into blocks, one task
   for each pair of blocks, so a group of any size is spread out; a task
   returns only links that join what it has not joined yet, a spanning forest.
4. The components of the links are the result.

Words are runs of anything but ASCII white space, A-Z lower-cased.  Defined
results: a text of fewer than ``words`` words has its whole sequence as one shingle;
null, empty and blank texts have an empty set, link with nothing and are their
own component; a null id is its own component unless its text is linked to one
with an id; repeated rows are linked copies; a component without any id has a
null component_id.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, ready, same
from .components import components

#: The query's rule: words of a shingle; links need 100 * overlap >= PERCENT * union.
WORDS, PERCENT = 3, 90
#: Classes and shingles of a block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 400_000
#: Segments to spare, as a share of the hashes in which linked sets can differ.
SURPLUS = 0.3
#: Digests that a reading task remembers, to state the keys of copies once; emptied when full.
MEMORY = 200_000
#: Bits of the filter that holds back texts without candidates (1 MB).
SIFT_BITS = 1 << 23
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Word hashes, remembered up to a bound."""

    def __init__(self, memory: int = 60_000, size: int = WORDS):
        self.known: dict[str, int] = {}
        self.memory, self.size = memory, size

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.memory:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Ascending distinct hashes of a text's shingles."""
        w = words_of(text)
        if not w:
            return np.empty(0, dtype=np.uint64)
        h = self.words(w)
        k = min(self.size, len(h))
        acc = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            acc = _mix(acc * _M2 + h[i:len(h) - k + 1 + i])
        return np.unique(acc)


def digest_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _step_starts(up_to: int, percent: int = PERCENT) -> list[int]:
    """First sizes of the steps; each step is about half as large again as the one before, or more if
    linked sets may differ by more than that."""
    starts = [1]
    while starts[-1] <= up_to:
        starts.append(max(starts[-1] + 1, starts[-1] * 3 // 2, -(-starts[-1] * 100 // percent)))
    return starts


class Steps:
    """Size steps, extended as sizes need them."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.starts = np.array(_step_starts(1 << 20, percent))

    def _reach(self, n: int) -> None:
        if n >= self.starts[-3]:
            self.starts = np.array(_step_starts(4 * n, self.percent))

    def of(self, n: int) -> list[int]:
        """The step of a size, and the next one if a linked set can be in it.  (Steps grow by more
        than 100 / percent or hold one size, so it cannot be further up.)"""
        self._reach(n)
        step = int(np.searchsorted(self.starts, n, side="right")) - 1
        return [step, step + 1] if n * 100 // self.percent >= self.starts[step + 1] else [step]

    def differ(self, n: int) -> int:
        """Hashes in which a set of n and a linked one can differ, at most."""
        return (n + n * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def segments(self, step: int) -> int:
        """One more than linked sets up to this step's largest size can differ in, and those to spare."""
        most = 2 * (int(self.starts[step + 1]) - 1) * (100 - self.percent) // (100 + self.percent)
        return most + 1 + int(most * SURPLUS)


def stated(shingles: np.ndarray, steps: Steps) -> tuple[np.ndarray, list[int]]:
    """All segment keys of a set, whose last bit is that of the step, and for each last bit how many of the
    most frequent ones it can leave out."""
    keys, spare = [], [0, 0]
    for step in steps.of(len(shingles)):
        found, spare[step & 1] = segment_keys(shingles, step, steps.segments(step), steps.differ(len(shingles)))
        keys.append(found)
    return np.concatenate(keys), spare


def stated_keys(shingles: np.ndarray, steps: Steps) -> np.ndarray:
    return stated(shingles, steps)[0]


def segment_keys(shingles: np.ndarray, step: int, count: int, differ: int) -> tuple[np.ndarray, int]:
    """For each of ``count`` segments a hash of its content, the step and its number; and how many of
    them the set can leave out.

    A linked set agrees in all but ``differ`` segments, so of any order of the keys the first
    ``differ + 1`` have one in common.  Empty segments are the last in that order.  They would group
    strangers: they are stated only where the segments with any are not more than ``differ``.
    """
    at = (_mix(shingles) % np.uint64(count)).astype(np.int64)
    sums = np.zeros(count, dtype=np.uint64)
    other = np.zeros(count, dtype=np.uint64)
    np.add.at(sums, at, _mix(shingles + _M1))
    np.add.at(other, at, _mix(shingles ^ _M2))
    place = np.arange(count, dtype=np.uint64) + np.uint64(step) * np.uint64(1 << 40)
    keys = (_mix(_mix(sums + place) + other) & ~np.uint64(1) | np.uint64(step & 1)).view(np.int64)
    filled = np.bincount(at, minlength=count) > 0
    spare = int(filled.sum()) - differ - 1
    return (keys[filled], spare) if spare >= 0 else (keys, 0)


# ---- the trie ----

class Node:
    """A chain of hashes that no other set shares in part, and what follows it."""

    __slots__ = ("hashes", "size", "last", "children", "ends", "least", "most")

    def __init__(self, hashes: list[int], pack=frozenset):
        self.hashes = pack(hashes)
        self.size, self.last = len(hashes), hashes[-1] if hashes else 0
        self.children: list[Node] = []
        self.ends: list[int] = []
        self.least, self.most = 1 << 60, 0


def build(sets: list[list[int]], which: list[int], pack=frozenset) -> Node:
    """Trie of the sets numbered in ``which``, each ascending; ``pack`` holds the hashes of a node."""
    root = Node([], pack)
    ordered = sorted(which, key=sets.__getitem__)

    def grow(node: Node, members: list[int], depth: int) -> None:
        """``members``: sorted sets that are equal up to ``depth``."""
        todo = [(node, members, depth)]
        while todo:
            node, members, depth = todo.pop()
            sizes = [len(sets[m]) for m in members]
            node.least, node.most = min(sizes), max(sizes)
            node.ends = [m for m in members if len(sets[m]) == depth]
            for _, same_first in groupby((m for m in members if len(sets[m]) > depth), key=lambda m: sets[m][depth]):
                group = list(same_first)
                a, b = sets[group[0]], sets[group[-1]]  # sorted: the ends differ first
                end = depth + 1
                stop = min(len(a), len(b))
                while end < stop and a[end] == b[end]:
                    end += 1
                child = Node(a[depth:end], pack)
                node.children.append(child)
                todo.append((child, group, end))

    if ordered:
        grow(root, ordered, 0)
    return root


def linked(overlap: int, m: int, n: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (m + n - overlap)


def search(trie: Node, x, ascending: list[int], skip, percent: int = PERCENT, common=None) -> Iterator[int]:
    """Sets of the trie that link with x; those for which ``skip`` is true are not looked at.

    ``x`` holds the hashes of ``ascending`` as the trie's nodes hold theirs; ``common`` counts what two have in common.
    """
    n, both = len(ascending), 100 + percent
    common = common or (lambda a, b: len(a & b))
    todo = [(trie, 0, 0)]  # node, overlap, hashes above it that x lacks
    while todo:
        node, overlap, lacking = todo.pop()
        if node.size:
            shared = common(node.hashes, x)
            overlap += shared
            lacking += node.size - shared
        # a set of m hashes needs an overlap of at least percent * (m + n) / both
        if lacking * both > 100 * node.most - percent * n:
            continue
        passed = bisect_right(ascending, node.last) if node.size else 0
        if (passed - overlap) * both > 100 * n - percent * node.least:
            continue  # x has too many hashes that no set below has
        for m in node.ends:
            if not skip(m) and linked(overlap, overlap + lacking, n, percent):
                yield m
        for child in node.children:
            if not (not child.children and len(child.ends) == 1 and skip(child.ends[0])):
                todo.append((child, overlap, lacking))


class Forest:
    """Union-find over the sets of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def join_cell(sets: list[np.ndarray], left: list[int], right: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets in ``left`` and those in ``right`` (which may
    be the same list: links within it)."""
    lists, shared = numbered(sets)

    def bits(numbers: list[int]) -> int:
        """The shared ones of ascending numbers as bits of one integer."""
        held = np.array(numbers[:bisect_left(numbers, shared)], dtype=np.int64)
        return int.from_bytes(np.packbits(np.bincount(held, minlength=1).astype(bool), bitorder="little").tobytes(), "little") if len(held) else 0

    trie, forest, out = build(lists, right, bits), Forest(len(sets)), []
    for x in left:
        for y in search(trie, bits(lists[x]), lists[x], lambda m, x=x: m == x or forest.find(m) == forest.find(x), percent,
                        lambda a, b: (a & b).bit_count()):
            if forest.join(x, y):
                out.append((x, y))
    return out


def numbered(sets: list[np.ndarray]) -> tuple[list[list[int]], int]:
    """The sets with numbers in place of hashes, each ascending, and below which number the hashes are that several have.

    Those come first, in the order of the smallest set that has them, so that the bits of small sets are few.
    """
    if not sets:
        return [], 0
    order = np.argsort([len(s) for s in sets], kind="stable")
    _, first, which, times = np.unique(np.concatenate([sets[k] for k in order]), return_index=True, return_inverse=True,
                                       return_counts=True)
    place = np.empty(len(first), dtype=np.int64)
    place[np.lexsort((first, times < 2))] = np.arange(len(first))
    out, at = [[]] * len(sets), 0
    for k in order:
        out[k] = np.sort(place[which[at:at + len(sets[k])]]).tolist()
        at += len(sets[k])
    return out, int((times > 1).sum())


# ---- Spark ----

def _read_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (null: an empty set), segment keys (null: a task's repeat)
    and how many of them to spare, of every row."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, steps, seen = Hasher(size=size), Steps(percent), set()
        for part in _slices(batches):
            out = []
            for t in part.column("text").to_pylist():
                s = hasher.shingles(t)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                digest = digest_of(s)
                out.append((len(s), digest, *((None, None) if digest in seen else stated(s, steps))))
                if len(seen) > MEMORY:
                    seen.clear()
                seen.add(digest)
            n, digests, keys, spare = zip(*out, strict=True)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"),
                                   "n_shingles": pa.array(n, pa.int64()), "digest": pa.array(digests, pa.binary()),
                                   "keys": pa.array(keys, pa.list_(pa.int64())), "spare": pa.array(spare, pa.list_(pa.int32()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        read, f"doc_id {kind}, text_hash long, n_shingles long, digest binary, keys array<long>, spare array<int>")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _classes(full: DataFrame) -> DataFrame:
    """A row for each set, with one of its rows, from which it can be read again."""
    return full.groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"),
        F.first("spare", ignorenulls=True).alias("spare"), F.min(F.struct("doc_id", "text_hash")).alias("at"))


def _candidates(full: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, least): classes and the least one with which they share a key that both have left.

    The keys are dealt out once; how many sets state a key, and whether more than one does, is seen
    where its rows meet.
    """
    by_key = Window.partitionBy("key")
    rows = full.select(_short("digest").alias("node"), F.explode("keys").alias("key"))
    met = rows.select("node", "key", F.count(F.lit(1)).over(by_key).alias("times"), F.min("node").over(by_key).alias("least"),
                      F.max("node").over(by_key).alias("most")).filter("least < most").select("node", "key", "times")
    to_spare = classes.select(_short("digest").alias("of"), "spare")
    order = Window.partitionBy("node", "step").orderBy(F.desc("times"), F.desc("key"))
    ranked = met.join(to_spare, F.col("node") == F.col("of")).withColumn("step", F.col("key").bitwiseAND(1).cast("int"))
    left = ranked.select("node", "key", F.col("spare")[F.col("step")].alias("spare"),
                         F.dense_rank().over(order).alias("rank")).filter("rank > spare")
    return left.select("node", F.min("node").over(by_key).alias("least")).filter("least < node").distinct()


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and class (null: an empty set) of every row."""
    if words < 1 or not 1 <= percent <= 100:
        raise ValueError(f"words {words} and percent {percent}: at least one word, 1 to 100 percent")
    ready(docs.sparkSession)
    source = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = keep(_read_sets(source, words, percent), "jaccard-sets")
    full = rows.filter("digest IS NOT NULL")
    classes = keep(_classes(full), "jaccard-classes")
    candidates = keep(_candidates(full.filter("keys IS NOT NULL"), classes), "jaccard-pairs")
    grouped = keep(components(candidates, "node", "least"), "jaccard-candidates")
    links = _verified(source, classes, grouped, words, percent)
    linked_classes = components(links, "a", "b")
    # the least id of each component; classes without links are components of their own
    placed = classes.join(linked_classes.withColumnRenamed("node", "of"), F.col("digest") == F.col("of"), "left")
    placed = keep(placed.select("digest", "least_id", F.coalesce("root", "digest").alias("root")), "jaccard-placed")
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    result = placed.join(named, "root").select(F.col("digest").alias("class"), "component_id", "root")
    return (rows.drop("keys", "spare").join(result, F.col("digest") == F.col("class"), "left")
            .select("doc_id", "text_hash", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id"), "root", "class"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) without near copies.

    Of each component the row of the least id stays (null last; of one id, the least text hash).
    Rows with an empty set are in no group and stay.  Of rows that repeat id and text one stays.
    """
    found = near_copies(docs, words=words, percent=percent).filter("root IS NOT NULL")
    rows = keep(found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")), "jaccard-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    marked = rows.join(first, "root").withColumn(
        "stays", same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    gone = marked.filter("NOT stays OR times > 1").select(F.col("doc_id").alias("_gone_id"),
                                                         F.col("text_hash").alias("_gone_hash"))
    again = marked.filter("stays AND times > 1").select(F.col("doc_id").alias("_gone_id"),
                                                       F.col("text_hash").alias("_gone_hash"))
    at = same(docs["doc_id"], F.col("_gone_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_gone_hash"))
    one = docs.join(again, at, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(gone, at, "left_anti").unionByName(one)


def _short(digest: str) -> Column:
    """64 bits of a digest.  Candidates are grouped by these: two classes that share them are at
    worst compared in vain."""
    return F.xxhash64(digest)


def _sift(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``texts`` without most rows that are no member, so that few texts are shuffled to the members.

    A Bloom filter of ``SIFT_BITS`` bits, whatever the input: it lets every member pass, and the
    join decides.  With many more members than bits it lets everything pass.
    """
    mask = SIFT_BITS - 1

    def bits(key: Column) -> list[Column]:
        return [key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask)]

    places = members.select(F.explode(F.array(*bits(F.xxhash64("at.doc_id", "at.text_hash")))).alias("bit"))
    rows = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("held")).toPandas()
    words = np.zeros(SIFT_BITS // 64, dtype=np.int64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["held"].to_numpy(dtype=np.int64)
    held = texts.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    @F.pandas_udf("boolean")
    def passes(first: pd.Series, second: pd.Series) -> pd.Series:
        ok = np.ones(len(first), dtype=bool)
        for place in (first, second):
            at = place.to_numpy(dtype=np.uint64)
            ok &= (held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
        return pd.Series(ok)

    return texts.filter(passes(*bits(F.xxhash64("doc_id", "text_hash"))))


def _verified(source: DataFrame, classes: DataFrame, grouped: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, a spanning forest of each component at least."""
    spark = source.sparkSession
    n = partitions(spark)
    members = grouped.join(classes, grouped["node"] == _short("digest")).select("root", "digest", "n", "at")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    members = keep(members.join(sizes.select("root", blocks.alias("blocks")), "root"), "jaccard-members")
    texts = _sift(source.withColumn("text_hash", F.xxhash64("text")), members)
    found = texts.join(members, same(texts["doc_id"], F.col("at.doc_id")) & (texts["text_hash"] == F.col("at.text_hash")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(size=size)
        for part in _slices(batches):
            found = [hasher.shingles(t) for t in part.column("text").to_pylist()]
            good = [digest_of(s) == d for s, d in zip(found, part.column("digest").to_pylist(), strict=True)]
            out = pa.record_batch({"root": part.column("root"), "digest": part.column("digest"), "blocks": part.column("blocks"),
                                   "packed": pa.array([s.tobytes() for s in found], pa.binary())})
            yield out.filter(pa.array(good))

    packed = (found.select("root", "digest", "blocks", "text")
              .mapInArrow(sets, "root long, digest binary, blocks int, packed binary"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    # a block's sets go to every pair of blocks it is part of; a whole group is the pair (0, 0)
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    cells = (packed.withColumn("block", block).select("root", "digest", "packed", "block", F.explode(pair).alias("cell"))
             .select("root", "cell.i", "cell.j", "block", "digest", "packed")
             .repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "digest"))
    return keep(cells.mapInPandas(partial(_join_cells, percent=percent), "a binary, b binary"), "jaccard-links")


def _join_cells(batches: Iterator[pd.DataFrame], percent: int = PERCENT) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell: the links of each cell, one cell in memory at a time."""
    def rows():
        for df in batches:
            yield from zip(df["root"], df["i"], df["j"], df["block"], df["digest"], df["packed"], strict=True)

    out = []
    for (_, i, j), cell in groupby(rows(), key=lambda r: r[:3]):
        left, right, digests, sets = [], [], [], []
        for _, _, _, block, digest, packed in cell:
            if digests and digests[-1] == bytes(digest):
                continue  # the class was read from several equal rows
            if block == i:
                left.append(len(sets))
            if block == j:
                right.append(len(sets))
            digests.append(bytes(digest))
            sets.append(np.frombuffer(bytes(packed), dtype=np.uint64))
        out += [(digests[a], digests[b]) for a, b in join_cell(sets, left, right, percent)]
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"])
