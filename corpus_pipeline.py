"""Training-corpus pipeline over ``documents``: each stage reads what the one before it kept.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``.  ``run`` writes each result as
Parquet to the shared work folder and reads it again for the next stage, so a lost executor costs
the tasks of one stage at most.  When a stage's result is written, the tables that it was made of
are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import stages
from riskloom.llm.common import drop_kept, keep, kept_so_far, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.keep_one_of_near_copies),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("pii", stages.redact_pii),
    ("byte_bpe", stages.encode_bpe),
]

#: The toxicity scores, the near-copy groups and the merges have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = kept_so_far()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{k}-{name}")
            drop_kept(spark, before)
    return docs
