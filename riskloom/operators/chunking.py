"""Recursive character chunking of whole documents.

Behaviour (size 500, overlap 50): a text is cut at every place of the
coarsest separator it contains, of blank line, line end and space; without
any, between all characters.  A separator belongs to the piece it begins.
Pieces shorter than the size are packed: a chunk takes pieces while it stays
within the size, and the next one begins with as many of the last pieces as
fit into the overlap and leave room for the piece that did not fit.  A piece
of the size or more is cut by the next finer separator on its own, and
nothing is packed across it.  Chunks are stripped of white space at both
ends; empty ones are dropped.

Here a text is never copied piece by piece: its cuts are offsets, and
packing moves two pointers over them, so time is linear in the text.

Spark: documents are independent, so a pass over Arrow batches splits each
whole text inside its task; the rows come back exploded as (doc_id, chunk_id,
chunk).  A text longer than ``LONG`` characters is dealt out over several tasks:

1. One scan looks for separators only.  Runs of short pieces and single long
   pieces are independent of each other; neighbours are put together to units of about
   ``LONG`` characters, and a piece longer than that is entered for its parts.  A run
   longer than that is cut, at separators, into windows.
2. Where packing stands in a window depends on the windows before.  A chunk's
   start alone decides where the next one starts, so each window packs from
   every start that its first chunk can have (less than the size further on) and
   answers with which start in the next window it ends.  Packings that meet
   are followed once from there.
3. The first start of a run is known; following the windows' answers, a few
   hundred numbers each, gives the start that holds in every window.
4. Units and windows give their chunks, each in a task of its own, and the
   counts of those before give the numbers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CHUNK_OVERLAP, CHUNK_SIZE
from ..session import scratch_path, ship_package, spread

SEPARATORS = ("\n\n", "\n", " ")


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    """Offsets of the pieces of text[start:end]: its ends, and in front of each separator."""
    cuts, at = [start], text.find(separator, start, end)
    while at >= 0:
        if at > start:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    return [*cuts, end]


def _packed(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of the chunks of neighbouring pieces, each shorter than the size.

    ``first`` is the first piece of the chunk that ends in front of piece ``k``.
    """
    first = 0
    for k in range(len(cuts) - 1):
        if cuts[k + 1] - cuts[first] <= size or first == k:
            continue
        yield cuts[first], cuts[k]
        while first < k and (cuts[k] - cuts[first] > overlap or cuts[k + 1] - cuts[first] > size):
            first += 1
    yield cuts[first], cuts[-1]


def _spans(text: str, start: int, end: int, level: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], start, end) < 0:
        level += 1
    if level == len(SEPARATORS):
        if size > 1:
            yield from _packed(range(start, end + 1), size, overlap)
        else:
            yield from ((k, k + 1) for k in range(start, end))
        return
    cuts = _cuts(text, start, end, SEPARATORS[level])
    run = [cuts[0]]  # pieces to pack together
    for a, b in zip(cuts, cuts[1:]):
        if b - a < size:
            run.append(b)
            continue
        if len(run) > 1:
            yield from _packed(run, size, overlap)
        yield from _spans(text, a, b, level + 1, size, overlap)
        run = [b]
    if len(run) > 1:
        yield from _packed(run, size, overlap)


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    chunks = (text[a:b].strip() for a, b in _spans(text, 0, len(text), 0, size, overlap)) if text else ()
    return [c for c in chunks if c]


# --- one long text in several tasks ---------------------------------------------

#: Characters of a text that one task splits, about.
LONG = 1 << 20
RUN, PIECE, WINDOW = 0, 1, 2


def _next_cut(text: str, at: int, end: int, separator: str) -> int:
    """Where the piece that begins at ``at`` ends."""
    found = text.find(separator, at + len(separator) if text.startswith(separator, at) else at + 1, end)
    return end if found < 0 else found


def _short_to(text: str, at: int, end: int, separator: str, size: int) -> int:
    """A cut up to which all pieces from ``at`` on are shorter than the size; ``at`` if the first is not."""
    if end - at < size:
        return end
    if len(separator) == 1:  # the last separator within the size: what lies before it is shorter
        return max(at, text.rfind(separator, at + 1, at + size))
    cut = _next_cut(text, at, end, separator)  # a longer one may overlap itself: one by one
    return cut if cut - at < size else at


def items(text: str, start: int, end: int, level: int, size: int, longest: int) -> Iterator[tuple[int, int, int, int]]:
    """(kind, level, start, end) of the independent parts of a text, in its order: runs of pieces to pack
    together, and pieces to split, these not longer than ``longest``."""
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], start, end) < 0:
        level += 1
    if level == len(SEPARATORS):
        yield RUN, level, start, end
        return
    run = at = start
    while at < end:
        cut = _short_to(text, at, end, SEPARATORS[level], size)
        if cut == at:
            cut = _next_cut(text, at, end, SEPARATORS[level])
            if at > run:
                yield RUN, level, run, at
            if cut - at > longest:
                yield from items(text, at, cut, level + 1, size, longest)
            else:
                yield PIECE, level + 1, at, cut
            run = cut
        at = cut
    if end > run:
        yield RUN, level, run, end


def _borders(text: str, start: int, end: int, level: int, longest: int) -> Iterator[tuple[int, int]]:
    """Windows of a run, from cut to cut."""
    at = start
    while at < end:
        goal = min(end, at + longest)
        if goal < end and level < len(SEPARATORS):
            if len(SEPARATORS[level]) == 1:
                goal = _next_cut(text, goal - 1, end, SEPARATORS[level])
            else:
                cut = at
                while cut < goal:
                    cut = _next_cut(text, cut, end, SEPARATORS[level])
                goal = cut
        yield at, goal
        at = goal


def units(text: str, size: int, longest: int) -> Iterator[tuple[int, int, int, list[tuple[int, int, int, int]]]]:
    """(run, start, end, items) in the order of the text: items to split in one task, or one window of a
    run that is longer than that, with the run's number (else -1)."""
    held, runs = [], 0
    for item in items(text, 0, len(text), 0, size, longest):
        if item[0] == RUN and item[3] - item[2] > longest:
            if held:
                yield -1, held[0][2], held[-1][3], held
                held = []
            for a, b in _borders(text, item[2], item[3], item[1], longest):
                # up to two sizes on decide about chunks that start in the window
                yield runs, a, min(item[3], b + 2 * size + 2), [(WINDOW, item[1], a, b)]
            runs += 1
            continue
        held.append(item)
        if held[-1][3] - held[0][2] >= longest:
            yield -1, held[0][2], held[-1][3], held
            held = []
    if held:
        yield -1, held[0][2], held[-1][3], held


class Packing:
    """Greedy packing in a window: offsets count from its start; ``goes_on`` if the run does after ``text``."""

    def __init__(self, text: str, level: int, end: int, goes_on: bool, size: int, overlap: int):
        self.end, self.size, self.overlap = end, size, overlap
        self.cuts: Sequence[int] = range(len(text) + 1)
        if level < len(SEPARATORS):
            self.cuts = _cuts(text, 0, len(text), SEPARATORS[level])
            if goes_on:
                self.cuts.pop()  # the end of the text is no cut

    def chunk(self, first: int) -> tuple[int, int]:
        """The cut at which the chunk ends that begins at a cut, and the cut at which the next one begins (-1: none)."""
        cuts = self.cuts
        k = max(first + 1, bisect_right(cuts, cuts[first] + self.size) - 1)
        if k == len(cuts) - 1:
            return k, -1
        fits = max(bisect_left(cuts, cuts[k] - self.overlap), bisect_left(cuts, cuts[k + 1] - self.size))
        return k, min(k, max(first + 1, fits))

    def exits(self, first_window: bool) -> dict[int, int]:
        """For every start that the first chunk of the window can have, the first start behind the window
        (-1: the run ends before)."""
        known: dict[int, int] = {}
        reach = 1 if first_window else bisect_left(self.cuts, min(self.end, self.size))
        for first in range(reach):
            path, at = [], first
            while at >= 0 and at not in known and self.cuts[at] < self.end:
                path.append(at)
                at = self.chunk(at)[1]
            out = known[at] if at in known else self.cuts[at] if at >= 0 else -1
            known.update(dict.fromkeys(path, out))
        return {self.cuts[k]: known[k] for k in range(reach)}

    def spans(self, start: int) -> Iterator[tuple[int, int]]:
        at = bisect_left(self.cuts, start)
        while at >= 0 and self.cuts[at] < self.end:
            k, following = self.chunk(at)
            yield self.cuts[at], self.cuts[k]
            at = following


def unit_spans(text: str, start: int, of: list[tuple[int, int, int, int]], entry: int, run_end: int, size: int,
               overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of the chunks of a unit, whose text begins at ``start``, as offsets in it."""
    for kind, level, a, b in of:
        if kind == WINDOW:
            goes_on = start + len(text) < run_end
            yield from Packing(text, level, b - start, goes_on, size, overlap).spans(entry - start)
        elif kind == PIECE:
            yield from _spans(text, a - start, b - start, level, size, overlap)
        elif level == len(SEPARATORS):
            yield from _spans(text, a - start, b - start, level, size, overlap)
        else:
            yield from _packed(_cuts(text, a - start, b - start, SEPARATORS[level]), size, overlap)


#: ``items`` holds kind, level, start and end of each item in turn.
_UNIT = "row long, unit int, run int, start long, run_end long, items array<bigint>, text string"


def _chunks_of_long(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int, longest: int) -> DataFrame:
    spark = docs.sparkSession
    longest = max(longest, 2 * size)

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "long-texts")

    def scan(batches):
        for pdf in batches:
            for row, text in zip(pdf["row"], pdf[text_col]):
                found = list(units(text, size, longest))
                ends = {run: of[0][3] for run, _, _, of in found if run >= 0}  # the last window's
                for k, (run, a, b, of) in enumerate(found):
                    yield pd.DataFrame({"row": [row], "unit": [k], "run": [run], "start": [a], "run_end": [ends.get(run, b)],
                                        "items": [[x for i in of for x in i]], "text": pd.Series([text[a:b]], dtype="object")})

    parts = written(docs.select("row", text_col).mapInPandas(scan, _UNIT), "long-units")

    def packing(r) -> Packing:
        _, level, _, end = r.items
        return Packing(r.text, level, int(end) - r.start, r.start + len(r.text) < r.run_end, size, overlap)

    def answer(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                exits = packing(r).exits(r.first)
                yield pd.DataFrame({"row": r.row, "run": r.run, "unit": r.unit, "start": r.start,
                                    "into": [[r.start + k for k in exits]],
                                    "out": [[r.start + v if v >= 0 else -1 for v in exits.values()]]})

    windows = parts.filter("run >= 0").repartition("row", "unit")
    firsts = parts.filter("run >= 0").groupBy("row", "run").agg(F.min("unit").alias("lead"))
    answers = (windows.join(firsts, ["row", "run"]).withColumn("first", F.col("unit") == F.col("lead"))
               .select("row", "unit", "run", "start", "run_end", "items", "text", "first")
               .mapInPandas(answer, "row long, run int, unit int, start long, into array<bigint>, out array<bigint>"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, out = None, []
        for r in pdf.sort_values("unit").itertuples(index=False):
            entry = r.start if entry is None else entry
            out.append((r.row, r.unit, entry))
            if entry >= 0:
                entry = dict(zip(r.into, r.out))[entry]
        return pd.DataFrame(out, columns=["row", "unit", "entry"])

    entries = answers.groupBy("row", "run").applyInPandas(follow, "row long, unit int, entry long")

    def emit(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.run >= 0 and r.entry < 0:
                    continue  # the run's last chunk began in an earlier window
                of = [tuple(r.items[k:k + 4].tolist()) for k in range(0, len(r.items), 4)]
                spans = unit_spans(r.text, r.start, of, int(r.entry), r.run_end, size, overlap)
                texts = [c for c in (r.text[a:b].strip() for a, b in spans) if c]
                yield pd.DataFrame({"row": r.row, "unit": r.unit, "place": range(len(texts)),
                                    "chunk": pd.Series(texts, dtype="object")})

    ready = parts.repartition("row", "unit").join(entries, ["row", "unit"], "left").fillna(-1, ["entry"])
    chunks = written(ready.select("row", "unit", "run", "start", "run_end", "items", "text", "entry")
                     .mapInPandas(emit, "row long, unit int, place int, chunk string"), "long-chunks")
    counts = chunks.groupBy("row", "unit").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("row").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    return (chunks.join(before, ["row", "unit"]).join(docs.select("row", id_col), "row")
            .select(id_col, (F.col("before") + F.col("place")).cast("int").alias("chunk_id"), "chunk"))


CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("chunk", T.StringType()),
])


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, longest: int = LONG) -> DataFrame:
    """(id, chunk_id, chunk) for every chunk of every whole document; null texts have none.  Texts of
    more than ``longest`` characters are split by several tasks, into the same chunks."""
    ship_package(docs.sparkSession)
    id_field = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, id_field.dataType)] + CHUNK_SCHEMA.fields)

    def run(batches):
        for pdf in batches:
            ids, cids, texts = [], [], []
            for doc_id, text in zip(pdf[id_col], pdf[text_col]):
                if text is None:
                    continue
                for k, c in enumerate(split_text(text, size, overlap)):
                    ids.append(doc_id)
                    cids.append(k)
                    texts.append(c)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=pdf[id_col].dtype),
                                "chunk_id": pd.Series(cids, dtype="int32"),
                                "chunk": pd.Series(texts, dtype="object")})

    whole = docs.select(id_col, text_col)
    long = F.length(text_col) > longest
    out = spread(whole.filter(~long)).mapInPandas(run, schema)
    if size < 2 or whole.filter(long).isEmpty():
        return spread(whole).mapInPandas(run, schema) if size < 2 else out
    return out.unionByName(_chunks_of_long(whole.filter(long), id_col, text_col, size, overlap, longest))
