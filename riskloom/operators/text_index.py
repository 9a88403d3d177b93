"""A kept TF-IDF index: a base, delta segments and tombstones, instead of a rebuild for each change.

Tables under the index's folder, each commit in a folder of its own:

* ``terms``  document, its terms, their counts: a row for each of the commit's documents, so that what
  is held against documents is shuffled in one piece, not as postings;
* ``docs``   document, present: the documents that the commit adds, replaces or removes;
* ``df``     term, change of its document frequency.

A commit counts once its row is in ``commits`` (folder, change of the number of
documents, whether it is a base), which is written last: readers see whole
commits only, and what a failed one left is never read.  Commits before the last base are not read.

Documents are replaced and removed by tombstones: the postings of a document are
valid if no later commit names it.  Only the documents of the delta segments
are held against postings, so Spark can broadcast them while they are few; the
frequencies are merged by adding up their changes, for which the terms of
replaced documents are taken from the index itself.  ``compact`` writes what is
valid as a new base.

Weights depend on all documents, so they are worked out when a search runs, from
the merged frequencies; the texts are read once, when they are added.

Defined results: rows without an id are not indexed; of several rows of one id in a
commit the texts count together as one document; documents without terms count
in the number of documents; removing an unknown id changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RETRIEVAL_K
from ..session import scratch_path
from .postings import postings_of, search_terms, term_lists

_COMMIT = "version int, folder string, documents long, base boolean"
_TERMS, _DOCS, _DF = "doc long, terms array<string>, tfs array<long>", "doc long, present boolean", "term string, n long"


class TextIndex:
    """The index in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- reading ---

    def _commits(self) -> list:
        """The commits since the last base, oldest first (a row each)."""
        rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").orderBy("version").collect()
        return rows[max((k for k, r in enumerate(rows) if r["base"]), default=0):]

    def _table(self, commits: list, name: str, schema: str) -> DataFrame:
        """One table of all commits, with the ``version`` of each row."""
        out = self.spark.createDataFrame([], f"{schema}, version int")
        for c in commits:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{c['folder']}/{name}")
            out = out.unionByName(part.withColumn("version", F.lit(c["version"])))
        return out

    def _named_later(self, commits: list) -> DataFrame:
        """Of each document of a delta segment the last version that names it, and whether it is there then."""
        deltas = self._table(commits[1:], "docs", _DOCS)
        return deltas.groupBy(F.col("doc").alias("named")).agg(F.max("version").alias("last"),
                                                               F.max_by("present", "version").alias("there"))

    def live_terms(self, commits: list | None = None) -> DataFrame:
        """(doc, term, tf) of the valid postings."""
        return postings_of(self._live_rows(commits), "doc")

    def _live_rows(self, commits: list | None = None) -> DataFrame:
        """(doc, terms, tfs) of the valid rows."""
        commits = self._commits() if commits is None else commits
        rows = self._table(commits, "terms", _TERMS)
        if len(commits) > 1:
            rows = rows.join(self._named_later(commits), F.col("doc") == F.col("named"), "left").filter(
                F.col("last").isNull() | (F.col("version") >= F.col("last")))
        return rows.select("doc", "terms", "tfs")

    def live_documents(self, commits: list | None = None) -> DataFrame:
        """(doc) of the documents that are there."""
        commits = self._commits() if commits is None else commits
        rows = self._table(commits, "docs", _DOCS)
        return rows.groupBy("doc").agg(F.max_by("present", "version").alias("there")).filter("there").select("doc")

    def frequencies(self, commits: list | None = None) -> DataFrame:
        """(term, df), the changes of all segments added up."""
        commits = self._commits() if commits is None else commits
        return self._table(commits, "df", _DF).groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    def size(self, commits: list | None = None) -> int:
        return sum(c["documents"] for c in (self._commits() if commits is None else commits))

    def search(self, queries: DataFrame, q_id: str, k: int = RETRIEVAL_K, text_col: str = "text") -> DataFrame:
        """(q_id, rank, doc, score) of the k best documents of the last commit."""
        commits = self._commits()
        rows = self._live_rows(commits)
        if len(commits) > 1:  # what is valid is worked out once, the search reads it twice
            path = scratch_path(self.spark, "live-terms")
            rows.write.parquet(path)
            rows = self.spark.read.parquet(path)
        return search_terms(queries, rows, self.frequencies(commits), self.size(commits), q_id, "doc", text_col, k)

    # --- writing ---

    def _write(self, folder: str, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/{folder}/{name}"
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def _commit(self, version: int, folder: str, documents: int, base: bool) -> None:
        self.spark.createDataFrame([(version, folder, documents, base)], _COMMIT).coalesce(1).write.mode("append").parquet(
            f"{self.path}/commits")

    def _segment(self, commits: list, added: DataFrame, present: bool, base: bool) -> None:
        """Writes ``added`` (doc, text), or tombstones of its ids if not ``present``, and publishes them."""
        version, folder = (commits[-1]["version"] + 1 if commits else 1), f"segment-{uuid.uuid4().hex[:12]}"
        rows = added.filter(F.col("doc").isNotNull())
        docs = self._write(folder, "docs", rows.select("doc").distinct().withColumn("present", F.lit(present)))
        new = self.spark.createDataFrame([], _TERMS)
        if present:  # the rows of a document are in one place already
            new = term_lists(rows, "doc", "text")
        new = self._write(folder, "terms", new)
        change = new.select(F.explode("terms").alias("term"), F.lit(1).alias("n"))
        count = docs.count() if present else 0
        if commits:  # what the documents had before goes
            before = self._live_rows(commits).join(docs.select("doc"), "doc", "left_semi")
            change = change.unionByName(before.select(F.explode("terms").alias("term"), F.lit(-1).alias("n")))
            count -= self.live_documents(commits).join(docs.select("doc"), "doc", "left_semi").count()
        self._write(folder, "df", change.groupBy("term").agg(F.sum("n").cast("long").alias("n")).filter("n <> 0"))
        self._commit(version, folder, count, base)

    @classmethod
    def create(cls, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
        """A new index of ``docs`` in a folder that does not exist yet."""
        index = cls(docs.sparkSession, path)
        index._segment([], _named(docs, id_col, text_col), True, True)
        return index

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds documents; those whose ids are there already are replaced."""
        self._segment(self._commits(), _named(docs, id_col, text_col), True, False)

    def remove(self, docs: DataFrame, id_col: str = "doc_id") -> None:
        """Removes the documents with these ids."""
        ids = docs.select(F.col(id_col).cast("long").alias("doc"), F.lit(None).cast("string").alias("text"))
        self._segment(self._commits(), ids, False, False)

    def compact(self) -> None:
        """Writes the valid postings as a new base."""
        commits, folder = self._commits(), f"segment-{uuid.uuid4().hex[:12]}"
        self._write(folder, "terms", self._live_rows(commits))
        docs = self._write(folder, "docs", self.live_documents(commits).withColumn("present", F.lit(True)))
        self._write(folder, "df", self.frequencies(commits).select("term", F.col("df").alias("n")))
        self._commit(commits[-1]["version"] + 1, folder, docs.count(), True)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
