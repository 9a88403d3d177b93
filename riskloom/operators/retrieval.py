"""Retrieval: exact nearest vectors, TF-IDF top-k, context and prompts.

The searches are in ``nearest`` (metric pruning) and ``postings`` (term upper
bounds); here their hits become context texts and chat messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SYSTEM_TEMPLATE
from .nearest import best_of_block, nearest_neighbors
from .postings import terms, tfidf_topk

__all__ = ["best_of_block", "context_text", "nearest_neighbors", "prompt_messages", "system_message", "terms", "tfidf_topk"]


def context_text(hits: DataFrame, texts: DataFrame, q_id: str, d_id: str,
                 text_col: str = "text", queries: DataFrame | None = None) -> DataFrame:
    """(q_id, context): retrieved texts joined by a blank line, in rank order.
    Each group holds at most k rows.  The hits are few, so Spark broadcasts
    them where they are under its size threshold.  With ``queries`` there is a row for every one of
    them, and one without a hit has the empty context."""
    j = texts.select(d_id, text_col).join(hits, d_id)
    g = j.groupBy(q_id).agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("_r"))
    found = g.select(q_id, F.array_join(F.transform("_r", lambda x: x[text_col]), "\n\n").alias("context"))
    if queries is None:
        return found
    return queries.select(q_id).join(found, q_id, "left").withColumn("context", F.coalesce("context", F.lit("")))


def system_message(context: F.Column) -> F.Column:
    head, tail = SYSTEM_TEMPLATE.split("{context}")
    return F.concat(F.lit(head), context, F.lit(tail))


def prompt_messages(df: DataFrame, id_col: str, context: str = "context",
                    question: str = "question") -> DataFrame:
    """Two chat messages per row: system (with the context), then the question."""
    msgs = F.array(
        F.struct(F.lit(0).alias("position"), F.lit("system").alias("role"),
                 system_message(F.col(context)).alias("content")),
        F.struct(F.lit(1).alias("position"), F.lit("human").alias("role"),
                 F.col(question).alias("content")))
    return df.select(id_col, F.inline(msgs))
