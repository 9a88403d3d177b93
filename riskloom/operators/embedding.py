"""Chunk embeddings: a Spark ML text pipeline by default, or a caller's function.

Offline default: ``RegexTokenizer`` -> ``HashingTF`` -> ``IDF`` ->
``Normalizer`` (unit L2), so squared L2 between embeddings orders exactly
like cosine similarity.  A hosted embedding model can be plugged in as a
batch function ``list[str] -> list[list[float]]`` run by ``mapInPandas``
over Arrow batches (one call per batch, never per row).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


def text_embedding_estimator(text_col: str = "chunk", num_features: int = 1 << 18) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern="[^a-z]+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="embedding", p=2.0),
    ])


def embed_chunks(chunks: DataFrame, text_col: str = "chunk", model: PipelineModel | None = None,
                 keep_tokens: bool = False) -> tuple[DataFrame, PipelineModel]:
    """Fit (or reuse) the default pipeline; returns (chunks + sparse embedding vector, model),
    with ``keep_tokens`` also the array ``tokens``."""
    model = model or text_embedding_estimator(text_col).fit(chunks)
    out = model.transform(chunks).drop("_tf", "_tfidf")
    return (out.withColumnRenamed("_tokens", "tokens") if keep_tokens else out.drop("_tokens")), model


def vector_entries(col: str = "embedding") -> F.Column:
    """struct<size, indices, values> of a sparse vector column: its entries, never the full width."""
    return F.unwrap_udt(F.col(col))


def embed_with(df: DataFrame, fn: Callable[[list[str]], list[list[float]]],
               text_col: str = "chunk") -> DataFrame:
    """Apply a caller-supplied batch embedding function; adds ``embedding``
    as array<float>."""
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            vecs = fn(pdf[text_col].fillna("").tolist()) if len(pdf) else []
            yield pdf.assign(embedding=pd.Series(list(vecs), index=pdf.index, dtype="object"))

    return df.mapInPandas(run, schema)


def as_float_array(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Vector column -> array<float> (what the nearest-neighbour search reads)."""
    return df.withColumn(col, vector_to_array(F.col(col), "float32"))
