"""Explanations for denied applications through a caller-supplied completion function.

The function receives a batch of prompts (``list[list[dict(role, content)]]``)
and returns one string per prompt.  It runs inside ``mapInPandas`` so calls
are batched per Arrow batch and distributed across tasks.  A failing call
does not fail the job: each row of that batch is retried on its own, and a
row that still fails keeps its decision with ``explanation`` null and the
error text in ``explanation_error``.  No network client lives in this repo.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .retrieval import system_message

CompletionFn = Callable[[list[list[dict]]], list[str]]


def with_prompt(df: DataFrame, context: str = "context") -> DataFrame:
    """Adds ``system_prompt``: the system message carrying the context."""
    return df.withColumn("system_prompt", system_message(F.col(context)))


def explain_denials(df: DataFrame, fn: CompletionFn, system: str = "system_prompt",
                    question: str = "question", only_when: str | None = None) -> DataFrame:
    """Adds ``explanation`` and ``explanation_error`` to each row of ``df``;
    with ``only_when`` (a boolean column) other rows pass through with nulls,
    so no filter-and-join-back is needed."""
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [
        T.StructField("explanation", T.StringType()),
        T.StructField("explanation_error", T.StringType())])

    def run(batches):
        for pdf in batches:
            mask = (pdf[only_when].fillna(False).astype(bool).tolist() if only_when
                    else [True] * len(pdf))
            rows = [i for i, m in enumerate(mask) if m]
            prompts = [[{"role": "system", "content": pdf[system].iat[i]},
                        {"role": "human", "content": pdf[question].iat[i]}] for i in rows]
            expl: list = [None] * len(pdf)
            errs: list = [None] * len(pdf)
            try:
                res = fn(prompts) if prompts else []
                if len(res) != len(prompts):
                    raise ValueError("completion function returned a wrong number of results")
                for i, r in zip(rows, res):
                    expl[i] = r
            except Exception:  # isolate the failing rows
                for i, p in zip(rows, prompts):
                    try:
                        expl[i] = fn([p])[0]
                    except Exception as e:  # noqa: BLE001 - reported per row
                        errs[i] = str(e)
            yield pdf.assign(explanation=pd.Series(expl, index=pdf.index, dtype="object"),
                             explanation_error=pd.Series(errs, index=pdf.index, dtype="object"))

    return df.mapInPandas(run, schema)
