"""Benchmark items inside documents (operator 6), with DataFrame functions only.

Method: size-partitioned MinHash containment search.  A text is the set of
its five-word shingles, hashed to 64 bits; an item of q shingles is contained
in a document that has at least ``THRESHOLD`` of them.

* Items are partitioned by size.  An item's signature is its
  ``q - ceil(THRESHOLD * q) + 1`` smallest hashes.  A document may lack
  ``q - ceil(THRESHOLD * q)`` of the item's shingles, so one hash of the
  signature is among the document's whenever the item is contained: nothing
  is missed.
* A document's signature for a size partition are its hashes up to the
  largest one in any signature of that partition (its cut).  Signatures of a
  document are nested, so it is enough to look up the widest.  Its share of a
  document's shingles follows from the smallest items: about half with the given
  benchmark, all of them with an item of five words.
* Documents and items that share a signature hash are candidates, verified by
  exact containment of the shingles as texts.

Words are runs of letters and digits, lower-cased.  Nothing is forced to be
broadcast: the signature table is, where the session's size threshold allows,
else the lookup is a shuffled join that Spark splits where a shingle is hot.

Defined results: null and empty texts, and those of fewer than five words,
have no shingles: they contain nothing and are contained in nothing; rows that
repeat both id and text count once; several items of one id stay apart by
their texts, and the id is reported once for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, same

WORDS, THRESHOLD = 5, 0.8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _each_shingle(words: str, made) -> Column:
    """``made`` of the five words at every place; ``words`` must be a plain column."""
    w = F.col(words)
    n = F.size(w)
    places = F.when(n >= WORDS, F.sequence(F.lit(0), n - WORDS)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: made(*[w[i + k] for k in range(WORDS)]))


def with_hashes(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the shingle hashes of a text, in order."""
    return df.withColumn("_words", words_of(F.col(text))).withColumn(to, _each_shingle("_words", F.xxhash64)).drop("_words")


def with_shingles(df: DataFrame, text: str, to: str) -> DataFrame:
    """``df`` with the distinct shingles of a text."""
    return (df.withColumn("_words", words_of(F.col(text)))
            .withColumn(to, F.array_distinct(_each_shingle("_words", lambda *w: F.concat_ws(" ", *w)))).drop("_words"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of which it has at least ``threshold``.

    ``docs``: doc_id, text; ``items``: item_id, text.  Columns: doc_id, doc_hash (xxhash64 of the
    text), item_id, n_shingles (the item's), n_shared, containment.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", body.alias("text")).withColumn("doc_hash", F.xxhash64("text"))
    tests = items.select("item_id", F.col("text").cast("string").alias("item_text")).distinct().withColumn(
        "item_key", F.xxhash64("item_id", "item_text"))
    q = F.size("hashes")
    signed = (with_hashes(tests, "item_text", "hashes")
              .withColumn("hashes", F.array_sort(F.array_distinct("hashes"))).filter(q > 0)
              .withColumn("part", F.floor(F.log2(q)).cast("int"))
              .withColumn("signature", F.slice("hashes", F.lit(1), q - F.ceil(q * F.lit(threshold)).cast("int") + 1)))
    cuts = signed.groupBy("part").agg(F.max(F.element_at("signature", -1)).alias("cut")).collect()  # a row per doubling
    widest = max((r["cut"] for r in cuts), default=-(1 << 63))
    lookup = signed.select("item_key", F.explode("signature").alias("hash"))
    held = F.filter("hashes", lambda h: h <= widest)
    probes = with_hashes(texts, "text", "hashes").select("doc_id", "doc_hash", F.explode(held).alias("hash"))
    # written: texts are only shuffled to their candidates if these are over the session's broadcast threshold
    found = keep(probes.join(lookup, "hash").select("doc_id", "doc_hash", "item_key").distinct(), "contained-candidates")

    exact = with_shingles(tests, "item_text", "item_shingles").select("item_id", "item_key", "item_shingles")
    pairs = found.join(exact, "item_key")
    pairs = pairs.withColumnsRenamed({"doc_id": "_id", "doc_hash": "_hash"})
    # the candidates' texts: all rows of a pair's document are the same, so one will do
    near = texts.join(pairs.select("_id", "_hash").distinct(),
                      same(F.col("doc_id"), F.col("_id")) & (F.col("doc_hash") == F.col("_hash")), "left_semi")
    near = near.dropDuplicates(["doc_id", "doc_hash"])
    sets = with_shingles(near, "text", "shingles").select("doc_id", "doc_hash", "shingles")
    shared = F.size(F.array_intersect("item_shingles", "shingles"))
    return (pairs.join(sets, same(F.col("doc_id"), F.col("_id")) & (F.col("doc_hash") == F.col("_hash")))
            .select("doc_id", "doc_hash", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"),
                    shared.cast("long").alias("n_shared"))
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
            .filter(F.col("containment") >= threshold))


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) that contain no item."""
    dirty = contained_items(docs, items, threshold).select(
        F.col("doc_id").alias("_dirty_id"), F.col("doc_hash").alias("_dirty_hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(dirty, same(docs["doc_id"], F.col("_dirty_id")) & (text_hash == F.col("_dirty_hash")), "left_anti")
