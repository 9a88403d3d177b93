"""Repeated passages of whole texts (operator 1).

Method: content-defined chunking with a gear rolling hash.  Each byte shifts
the hash left and adds its entry of a gear table, so the hash at a place
depends on the last ``WINDOW`` bytes only.  A chunk ends where the hash is
below all others within ``RADIUS`` bytes on either side.  This rule looks at
nothing but the bytes around a place, so an insertion moves no cut beyond its
neighbourhood, and equal passages are cut alike wherever they stand.  (The
usual masked rule with a least chunk size depends on the cut before, and
needs a few chunks until two texts cut alike again.)  Periodic text has no such
place, its least hash comes back with every period.  There the least places are
the same in every period, and a chunk ends at each of them that is ``TIED``
bytes or a little more after the last: it is a whole number of periods from a
phase that depends on the period's bytes alone, so all chunks of a run are
equal, also to those of the run elsewhere.  A stretch without any least place
is cut every ``LONGEST`` bytes.  Chunks are variable: ``RADIUS`` + 1 to
``LONGEST`` bytes, about twice ``RADIUS``.

Chunks are deduplicated by a 96-bit digest: the first place by (doc_id, text
hash, start) keeps a chunk, all other places repeat it.  Digests are counted
map-side; the places meet the few repeated digests in a join that Spark splits
where a digest is hot.  Neighbouring repeated chunks of a text form a run; runs
of at least ``LEAST_WORDS`` words are repeated passages.  A passage of a little
over twice the largest chunk always has whole chunks inside.

Defined results: null and empty texts have no chunks; rows that repeat both
id and text are one document; a null id sorts first; a passage that is
repeated in one text is a repetition like any other; offsets are bytes of the
UTF-8 text (and moved to whole characters where text is cut out).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ready, same

WINDOW, RADIUS, LONGEST = 16, 24, 256
#: Bytes of a chunk of periodic text, rounded up to whole periods.
TIED = 64
LEAST_WORDS = 25
#: Bytes of a digest: 96 bits, so that even 10**13 chunks hold no two that share one by chance.
DIGEST_BYTES = 12
#: Texts a worker cuts at a time.
BATCH = 256


def _gear_table() -> np.ndarray:
    """256 numbers of 32 bits from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear_table()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte (of the bytes so far, at the start), by doubling the window."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def _least_within(h: np.ndarray, radius: int) -> np.ndarray:
    """At each place the least of the ``radius`` values before it (places too early: the largest value)."""
    n = len(h)
    padded = np.concatenate([np.full(radius, np.iinfo(h.dtype).max, dtype=h.dtype), h])
    span, low = 1, padded
    while span * 2 <= radius:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    # low[i]: the least of padded[i:i + span]; two of them cover `radius` values
    return np.minimum(low[:n], low[radius - span:radius - span + n])


def _thinned(tied: np.ndarray) -> np.ndarray:
    """Of places that are least together with others near them: the first of each run and those whole
    periods of ``TIED`` bytes or more after it."""
    gaps = np.diff(tied)
    first = np.flatnonzero(np.concatenate([[True], gaps > RADIUS]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tied))))
    period = np.append(gaps, LONGEST)[first]  # a run of one place has no second one
    return tied[(np.arange(len(tied)) - first[run]) % -(-TIED // period)[run] == 0]


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one its length."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64)
    h = gear_hash(np.frombuffer(data, dtype=np.uint8))
    before = _least_within(h, RADIUS)
    after = _least_within(h[::-1].copy(), RADIUS)[::-1]
    least = (h <= before) & (h <= after)
    alone = (h < before) & (h < after)
    found = np.flatnonzero(alone) + 1
    tied = np.flatnonzero(least & ~alone) + 1
    if len(tied):
        found = np.union1d(found, _thinned(tied))
    # the first and last places are cut by the text's ends, not by its content
    found = found[(found > RADIUS) & (found < n - RADIUS)]
    ends = np.append(found, n)
    starts = np.concatenate([[0], ends[:-1]])
    gaps = ends - starts
    if gaps.max() > LONGEST:
        more = [np.arange(s + LONGEST, e, LONGEST) for s, e in zip(starts[gaps > LONGEST], ends[gaps > LONGEST], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunk_rows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Starts, sizes, words and digests of a text's chunks."""
    data = text.encode("utf-8", "surrogatepass")
    ends = cuts(data)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    blank = np.frombuffer(data, dtype=np.uint8) <= 32
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))  # of words
    words = np.diff(np.searchsorted(begins, np.append(starts, len(data))))
    digest = xxhash.xxh3_128_digest
    return starts, ends - starts, words, [digest(data[a:b])[:DIGEST_BYTES] for a, b in zip(starts.tolist(), ends.tolist())]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, text -> a row for each chunk, some hundred texts at a time."""
    for whole in batches:
        for first in range(0, whole.num_rows, BATCH):
            batch = whole.slice(first, BATCH)
            at, parts = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    parts.append(chunk_rows(text))
                    at.append(np.full(len(parts[-1][0]), k))
            if not parts:
                continue
            rows = pa.array(np.concatenate(at))
            starts, sizes, words = (pa.array(np.concatenate([p[k] for p in parts]).astype(np.int32)) for k in range(3))
            digests = pa.array([d for p in parts for d in p[3]], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), starts, sizes, words, digests],
                names=["doc_id", "text_hash", "start", "size", "words", "digest"])


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, size, words, digest: all chunks of all texts."""
    ready(docs.sparkSession)
    text = docs["text"].cast("string")
    source = docs.select("doc_id", text_hash(text).alias("text_hash"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_cut, f"doc_id {kind}, text_hash int, start int, size int, words int, digest binary")


def text_hash(text: Column) -> Column:
    """Tells apart texts of one id (32 bits are enough for that)."""
    return F.xxhash64(text).bitwiseAND(0x7FFFFFFF).cast("int")


def repeated_chunks(found: DataFrame) -> DataFrame:
    """The chunks whose digest occurs earlier, with the document that keeps it (first_doc_id)."""
    firsts = (found.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"),
                                          F.count(F.lit(1)).alias("times"))
              .filter("times > 1").select(F.col("digest").alias("of"), "first"))
    met = found.join(firsts, F.col("digest") == F.col("of"))
    kept = (same(F.col("doc_id"), F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
            & (F.col("start") == F.col("first.start")))
    return met.filter(~kept).select("doc_id", "text_hash", "start", "size", "words",
                                    F.col("first.doc_id").alias("first_doc_id"))


def passages(repeated: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_hash, start, end (bytes), n_chunks, n_words, first_doc_ids: runs of repeated chunks."""
    rows = repeated.dropDuplicates(["doc_id", "text_hash", "start"])
    text = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    begins = F.coalesce((F.lag("start").over(text) + F.lag("size").over(text) != F.col("start")).cast("int"), F.lit(1))
    runs = rows.withColumn("begins", begins).withColumn("run", F.sum("begins").over(text))
    grouped = runs.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"),
        F.count(F.lit(1)).alias("n_chunks"), F.sum("words").alias("n_words"),
        F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    return grouped.filter(F.col("n_words") >= least_words).drop("run")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Repeated passages of ``docs`` (doc_id, text): every place but the first."""
    return passages(repeated_chunks(keep(chunks(docs), "chunks")), least_words)


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the passages cut out of their texts."""
    ready(docs.sparkSession)
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, cut):
            if t is None or cut is None:
                return t
            data, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            for s in cut:
                parts.append(data[at:s["start"]])
                at = s["end"]
            parts.append(data[at:])
            return "".join(p.decode("utf-8", "ignore") for p in parts)
        return pd.Series([one(t, c) for t, c in zip(texts, spans, strict=True)], dtype=object)

    at = same(docs["doc_id"], F.col("_id")) & (text_hash(docs["text"].cast("string")) == F.col("_hash"))
    return (docs.join(spans, at, "left").withColumn("text", cut_out(docs["text"].cast("string"), "_spans"))
            .select(*docs.columns))
