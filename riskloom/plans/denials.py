"""From texts to context and chat messages: the retrieval steps as plans.

documents -> chunks -> TF-IDF vectors -> the chunks nearest each denial's
question by cosine (for vectors of length 1 the order of squared L2) -> the
context in rank order -> system and human message.  The chunks are written
once, to the shared work folder, in the order of document and number, with a key that
keeps this order; they are read for the vectors and the context.

With a caller's embedding function the same steps run over its vectors:
texts -> vectors -> exact nearest -> context.

Questions are made from a template, so many have the same words: each group of those is searched once, and
its context is joined to the questions of the group.  A question without any hit has the empty context and
its messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import question_text
from ..operators.chunking import chunk_documents
from ..operators.embedding import embed_with
from ..operators.postings import indexed, query_groups, search_groups
from ..operators.retrieval import context_text, nearest_neighbors, prompt_messages
from ..schemas import RETRIEVAL_K
from ..session import scratch_path


def keyed_chunks(docs: DataFrame) -> DataFrame:
    """(chunk_key, doc_id, chunk_id, text) of all chunks, written; keys ascend by document and number."""
    path = scratch_path(docs.sparkSession, "chunks")
    chunks = chunk_documents(docs).select("doc_id", "chunk_id", F.col("chunk").alias("text"))
    ordered = chunks.repartitionByRange("doc_id", "chunk_id", "text").sortWithinPartitions("doc_id", "chunk_id", "text")
    ordered.withColumn("chunk_key", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def denial_context(denied: DataFrame, docs: DataFrame, k: int = RETRIEVAL_K) -> DataFrame:
    """(app_id, question, context, chunks) of each denied application; ``chunks`` names the document and
    number of each chunk of the context, in rank order."""
    chunks = keyed_chunks(docs)
    asked = denied.select("app_id", question_text().alias("text"))
    members, groups = query_groups(asked, "app_id", "text")
    hits = search_groups(groups, *indexed(chunks, "chunk_key", "text"), chunks.count(), "chunk_key", k)
    each = F.struct("rank", "doc_id", "chunk_id", "text")
    found = hits.join(chunks, "chunk_key").groupBy("qid").agg(F.array_sort(F.collect_list(each)).alias("each"))
    path = scratch_path(docs.sparkSession, "contexts")
    found.join(groups, "qid").select("bag", "each").write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    none = F.array().cast("array<struct<doc_id:bigint,chunk_id:int>>")
    return asked.withColumnRenamed("text", "question").join(members, "app_id", "left").join(found, "bag", "left").select(
        "app_id", "question", F.coalesce(F.array_join(F.col("each.text"), "\n\n"), F.lit("")).alias("context"),
        F.coalesce(F.transform("each", lambda x: F.struct(x["doc_id"].cast("long").alias("doc_id"), x["chunk_id"].alias("chunk_id"))),
                   none).alias("chunks"))


def denial_messages(denied: DataFrame, docs: DataFrame, k: int = RETRIEVAL_K) -> DataFrame:
    """(app_id, position, role, content): two messages for each denied application, grounded on the
    ``k`` chunks of ``docs`` nearest its question."""
    return prompt_messages(denial_context(denied, docs, k), "app_id")


def embedded_context(queries: DataFrame, texts: DataFrame, fn: Callable[[list[str]], list[list[float]]], q_id: str,
                     d_id: str, k: int = RETRIEVAL_K) -> DataFrame:
    """(q_id, context, nearest): the ``k`` texts nearest each query by the vectors of a caller's batch function,
    joined in rank order, and their ids."""
    path = scratch_path(texts.sparkSession, "embedded")
    embed_with(texts.select(d_id, "text"), fn, "text").write.parquet(path)
    corpus = texts.sparkSession.read.parquet(path)
    asked = embed_with(queries.select(q_id, "text"), fn, "text")
    hits = nearest_neighbors(asked, corpus, q_id, d_id, k=k).withColumnRenamed("neighbor_id", d_id)
    path = scratch_path(texts.sparkSession, "hits")
    hits.write.parquet(path)
    hits = texts.sparkSession.read.parquet(path)
    ids = hits.groupBy(q_id).agg(F.array_sort(F.collect_list(F.struct("rank", d_id)))[d_id].alias("nearest"))
    context = context_text(hits, texts, q_id, d_id, queries=queries)
    return context.join(ids, q_id, "left").withColumn("nearest", F.coalesce("nearest", F.array().cast("array<bigint>")))
