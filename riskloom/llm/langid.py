"""Language of whole texts by compression (operator 12).

Method: compression classification.  Each language of the labelled texts gets a
Zstandard dictionary of raw content, pieces of its texts.  A text, A-Z and other
capitals lower-cased, is encoded with every dictionary, in segments of
``SEGMENT`` bytes, so that a long text does not become its own dictionary; the
language of the smallest total wins.  If the total of the second is within
``NARROW`` of it, the answer is rejected.

Learning reads all labelled texts, and keeps a bounded sample: at most
``SAMPLE`` distinct texts in all, the same number of each language (lowest hash;
a text that is there in many copies counts once).  Two of three give a piece
of ``PIECE`` characters, from a place set by the hash, to the dictionaries, which hold ``DICTIONARY``
bytes each and ``IN_ALL`` together at most.  The third ones are
predicted, whole, by the tasks; a logistic curve through (bytes between first and
second, right or wrong) turns margins into the score, the chance to be right.
Classifying is row-local: the dictionaries travel with the function.

Defined results: a null text and one without a letter have the language ``und``,
score 0 and are rejected; of equal totals the language with more labelled
rows wins, then the first by name; with one language learnt its score is 1;
with none every text is ``und``.  Labelled rows without an id are not learnt
from.  Beyond ``SAMPLE`` languages those with most rows are learnt.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, ready
from .toxicity import fit_curve, is_held_out

#: Labelled texts to learn from, in all and of each language, at most.
SAMPLE, EACH = 20_000, 3_000
#: Characters of a text that go to a dictionary; bytes of a dictionary and of all of them.
PIECE, DICTIONARY, IN_ALL = 200, 192 * 1024, 16 * 1024 * 1024
#: Bytes that are encoded at once; effort of the encoder.
SEGMENT, LEVEL = 4096, 6
#: Share of the second total by which the first must be smaller.
NARROW = 0.01
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """A dictionary for each language, the most frequent language first, and the curve of the score."""

    dictionaries: dict[str, bytes]
    curve: tuple[float, float] = (0.0, 1.0)
    encoders: list = field(default_factory=list, repr=False)

    def to_json(self) -> str:
        return json.dumps([[(k, base64.b64encode(v).decode()) for k, v in self.dictionaries.items()], self.curve])

    @classmethod
    def from_json(cls, sent: str) -> Model:
        found, curve = json.loads(sent)
        return cls({k: base64.b64decode(v) for k, v in found}, tuple(curve))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the text, encoded with each dictionary."""
        if not self.encoders:
            for content in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.encoders.append(zstandard.ZstdCompressor(
                    dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
        data = text.lower().encode("utf-8", "surrogatepass")
        parts = [data[k:k + SEGMENT] for k in range(0, len(data), SEGMENT)]
        return [sum(len(e.compress(p)) for p in parts) for e in self.encoders]

    def best(self, text: str | None) -> tuple[str, int, int]:
        """The language of the smallest total, that total and the second one."""
        if not self.dictionaries or not has_letter(text):
            return UNKNOWN, 0, 0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        return list(self.dictionaries)[order[0]], sizes[order[0]], sizes[order[1]] if len(order) > 1 else 0

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the answer is rejected."""
        lang, first, second = self.best(text)
        if not first:
            return UNKNOWN, 0.0, True
        if len(self.dictionaries) == 1:
            return lang, 1.0, False
        a, b = self.curve
        score = 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * math.log1p(second - first)))))
        return lang, score, second - first < NARROW * second


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries and curve from the rows of ``docs`` (doc_id, text, lang) that are not held out."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                       & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("hash"))
    found = (rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("hash").alias("texts"))
             .orderBy(F.desc("rows"), "lang").limit(sample).collect())  # a row for each language, `sample` at most
    if not found:
        return Model({})
    share = min(EACH, max(1, sample // len(found)))
    rates = spark.createDataFrame([(r["lang"], min(1.0, 2 * share / r["texts"])) for r in found], "of string, rate double")
    lot = F.pmod(F.xxhash64(F.lit("lot"), "hash"), F.lit(1 << 30)) / float(1 << 30)
    drawn = (rows.join(F.broadcast(rates), F.col("lang") == F.col("of")).filter(lot < F.col("rate"))
             .groupBy("lang", "hash").agg(F.first("text").alias("text")))  # about twice the share of each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = keep(drawn.withColumn("place", place).filter(F.col("place") <= share), "langid-sample")
    start = (F.pmod("hash", F.greatest(F.lit(1), F.length("text") - PIECE)) + 1).cast("int")
    pieces = (chosen.filter("place % 3 <> 0").select("lang", "place", F.lower(F.substring("text", start, F.lit(PIECE))).alias("piece"))
              .orderBy("lang", "place").collect())  # `sample` pieces at most
    room = min(DICTIONARY, IN_ALL // len(found))
    contents = {r["lang"]: b"" for r in found}
    for r in pieces:
        contents[r["lang"]] += r["piece"].encode("utf-8", "surrogatepass") + b"\n"
    model = Model({k: v[:room] for k, v in contents.items() if v})
    sent = model.to_json()

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.from_json(sent)
        for df in batches:
            got = [m.best(t) for t in df["text"]]
            yield pd.DataFrame({"x": [round(math.log1p(b - a), 3) for _, a, b in got],
                                "y": [int(g[0] == lang) for g, lang in zip(got, df["lang"], strict=True)]})

    if len(model.dictionaries) > 1:
        points = (chosen.filter("place % 3 = 0").select("lang", "text").mapInPandas(tried, "x double, y int")
                  .groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).toPandas())
        # and of as many texts as there are languages, all without any margin, one is right
        blank = len(model.dictionaries)
        times = np.append(points["n"].to_numpy(dtype=int), [1, blank - 1])
        model.curve = fit_curve(np.repeat(np.append(points["x"].to_numpy(dtype=float), [0.0, 0.0]), times),
                                np.repeat(np.append(points["y"].to_numpy(dtype=float), [1.0, 0.0]), times))
    return model


def classified(model: Model, text: Column) -> Column:
    """struct<lang, score, rejected> of a text."""
    sent = model.to_json()

    @F.pandas_udf("struct<lang:string,score:double,rejected:boolean>")
    def classify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model.from_json(sent)
        for s in texts:
            yield pd.DataFrame([m.classify(t) for t in s], columns=["lang", "score", "rejected"])

    return classify(text)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    model = learn(docs, sample)
    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"),
                       classified(model, F.col("text").cast("string")).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")
