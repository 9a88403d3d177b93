"""Toxic passages of whole texts and a calibrated score (operator 2).

Method: maximum-scoring segment search.

1. For each word the texts that have it are counted over all texts, and over
   a bounded sample of labelled ones by label (a text of the sample that is
   there in several copies counts once).  A word's *forms* are the word itself
   and its first 4, 5 and 6 letters, so inflected forms share evidence.
2. A form's log-odds between the labels has an informative Dirichlet prior:
   the form's frequency in all texts, worth ``PRIOR`` texts for each one of the
   labelled sample.  Forms that are frequent everywhere thus need more evidence.
   Forms whose z value reaches ``Z`` and whose log-odds reach ``LEAST_ODDS``
   keep them, all others cost ``DRIFT``; a word scores the best of its forms.
3. A linear-time scan (Ruzzo and Tompa) finds every maximal scoring segment.
4. Extreme-value calibration (Karlin and Altschul): with ``lam`` solving
   ``E[exp(lam * score)] = 1`` over words of clean texts, a segment of score S
   in a text of n words is as good as chance with probability
   ``1 - exp(-n * exp(-lam * S))``.  Segments below ``SIGNIFICANT`` are
   reported as toxic passages.  The sum over a text's significant segments of
   ``lam * S - log n``, on a log scale, is the evidence of the text, and a
   logistic curve fitted on the sample turns it into a probability of label 1.

Model size: the labelled sample is at most ``SAMPLE`` rows (lowest hash of
the id), so the forms that can reach Z, and with them the broadcast table,
are bounded by the words of that many texts; the counts behind the prior cover
every text.

Defined results: a null or wordless text has no segments and the score of no
evidence; labels that are null do not count, one label of 1 among several of
an id counts as 1; without labelled rows of both kinds every score is 0;
repeated rows score alike.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, ready

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
#: z value that a form's log-odds must reach; cost of any other word; largest chance of a reported segment.
Z, DRIFT, SIGNIFICANT = 2.5, 0.35, 0.01
#: Log-odds that a form must reach: words that are merely a little more frequent are no evidence.
LEAST_ODDS = 2.0
#: Texts the prior is worth, for each text of the labelled sample.
PRIOR = 0.1
#: Letters of the word stems that count as forms.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Words a worker remembers; emptied when full.
MEMORY = 100_000
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
#: A space for any ASCII character that is no letter.
_APART = {k: " " for k in range(128) if not chr(k).isalpha()}


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return low.translate(_APART).split() if low.isascii() else _WORD.findall(low)


def forms_of(word: str) -> list[str]:
    """The word, and its stems marked by a star."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class Finder:
    """Which of the given forms a text has, by their numbers."""

    def __init__(self, forms: list[str]):
        self.whole = {f: k for k, f in enumerate(forms) if not f.endswith("*")}
        self.stems = {n: {f[:-1]: k for k, f in enumerate(forms) if len(f) == n + 1 and f.endswith("*")} for n in STEMS}

    def of(self, low: str) -> list[int]:
        """Those that a lower-case text has, each once."""
        words = set(low.translate(_APART).split() if low.isascii() else _LETTERS.findall(low))
        found = set(map(self.whole.get, words))
        for n, stems in self.stems.items():  # ascending lengths
            words = [w for w in words if len(w) > n]
            found.update(map(stems.get, {w[:n] for w in words}))
        found.discard(None)
        return list(found)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time.

    Ruzzo and Tompa's scan: candidates wait in a list with the cumulative sums on their left and
    right; a new one merges with those since the last candidate whose left sum is lower.  Each
    candidate remembers that one's place, so the search does not walk through all of them.
    """
    found: list[list] = []  # start, end, left sum, right sum, place of the last one with a lower left sum
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [k, k + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, r - left) for a, b, left, r, _ in found]


@dataclass
class Model:
    """Log-odds of significant forms, the extreme-value rate and the logistic curve."""

    odds: dict[str, float]
    lam: float = 1.0
    curve: tuple[float, float] = (-30.0, 0.0)
    drift: float = DRIFT
    hot: dict[str, float] = field(default_factory=dict, repr=False)
    cold: set[str] = field(default_factory=set, repr=False)

    def word_score(self, word: str) -> float:
        """The best log-odds of the word's forms, or the cost of a word without any."""
        return max([self.odds[f] for f in forms_of(word) if f in self.odds], default=-self.drift)

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and scores of the words that have a form with log-odds."""
        if not self.odds:
            return []
        if len(self.cold) + len(self.hot) > MEMORY:
            self.cold.clear()
            self.hot.clear()
        some = False
        for w in set(words) - self.cold:
            if w not in self.hot:
                score = self.word_score(w)
                if score <= 0:
                    self.cold.add(w)
                    continue
                self.hot[w] = score
            some = True
        return [(k, self.hot[w]) for k, w in enumerate(words) if w in self.hot] if some else []

    def word_segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal scoring segments in words.  The words between two hits cost the same each, so they
        are one step of the scan."""
        scores, places, last = [], [], -1
        for k, s in self.hits(words):
            if k > last + 1:
                scores.append(-self.drift * (k - last - 1))
                places.append(last + 1)
            scores.append(s)
            places.append(k)
            last = k
        return [(places[a], places[b - 1] + 1, s) for a, b, s in segments(scores)]

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant segments: first word, last word + 1, score, chance."""
        words, out = words_of(text), []
        for a, b, s in self.word_segments(words):
            chance = -math.expm1(-len(words) * math.exp(-self.lam * s))
            if chance <= SIGNIFICANT:
                out.append((a, b, s, chance))
        return out

    def evidence(self, text: str | None) -> float:
        """Log of one plus the evidence of all significant segments."""
        words = words_of(text)
        if not words:
            return 0.0
        log_n = math.log(len(words))
        least = -math.log(-math.log1p(-SIGNIFICANT))  # what lam * S - log n must reach
        parts = [x for _, _, s in self.word_segments(words) if (x := self.lam * s - log_n) >= least]
        return math.log1p(sum(parts))

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * evidence))))

    def score(self, text: str | None) -> float:
        return self.probability(self.evidence(text))

    def to_json(self) -> str:
        return json.dumps({"odds": self.odds, "lam": self.lam, "curve": self.curve, "drift": self.drift})

    @staticmethod
    def from_json(text: str) -> Model:
        m = json.loads(text)
        return Model(m["odds"], m["lam"], tuple(m["curve"]), m["drift"])


def rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lam with E[exp(lam * score)] = 1 (the mean score is negative), by bisection."""
    p = weights / weights.sum()
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (low, mid)
    return high


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of y on x by Newton's method, with a small ridge so that separable samples end."""
    a, b, m = 0.0, 0.0, np.column_stack([np.ones(len(x)), x])
    w = np.array([a, b])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -500, 500)))
        g = m.T @ (y - p) - 0.1 * np.array([0.0, w[1]])
        h = (m * (p * (1 - p))[:, None]).T @ m + np.diag([1e-6, 0.1])
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4 (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out, with counts of all ``docs``."""
    ready(docs.sparkSession)
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample))  # at most `sample` rows of two numbers: broadcast
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    labelled = texts.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).groupBy(
        F.xxhash64("text").alias("_hash")).agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic")).drop("_hash")
    chosen = texts.join(F.broadcast(labelled), F.col("doc_id") == F.col("_id")).select("text", "_toxic")

    def forms_of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {0: Counter(), 1: Counter()}
        for df in batches:
            for text, label in zip(df["text"], df["_toxic"], strict=True):
                seen[label].update({f for w in set(words_of(text)) for f in forms_of(w)})
        yield pd.DataFrame([(f, c, k) for k, forms in seen.items() for f, c in forms.items()],
                           columns=["form", "n", "label"])

    # forms of the sample's texts, whose number `sample` bounds
    by_label = chosen.mapInPandas(forms_of_texts, "form string, n long, label int").groupBy("form").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"))
    total = chosen.agg(F.count_if(F.col("_toxic") == 0).alias("n0"), F.count_if(F.col("_toxic") == 1).alias("n1")).first()
    if not total["n0"] or not total["n1"]:
        return Model({})
    mass = PRIOR * (total["n0"] + total["n1"])
    # only forms that can become evidence are counted: those of the sample's texts of label 1, whose number `sample` bounds
    candidates = keep(by_label.filter((F.col("n1") > 0) & (F.col("n0") + F.col("n1") >= 3))
                      .withColumn("id", F.monotonically_increasing_id()), "toxicity-forms")
    wanted = candidates.select("id", "form").toPandas()

    @F.arrow_udf("array<long>")
    def candidates_of(lows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder, ids = Finder(wanted["form"].tolist()), wanted["id"].to_numpy()
        for a in lows:
            found = [finder.of(t) for at in range(0, len(a), 256) for t in a.slice(at, 256).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            numbers = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=ends[-1])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[numbers], pa.int64()))

    # how many of all texts have a form
    everywhere = (texts.select(F.explode(candidates_of(F.lower("text"))).alias("id"))
                  .join(F.broadcast(candidates.select("id", "n0", "n1")), "id")
                  .groupBy("id", "n0", "n1").agg(F.count(F.lit(1)).alias("n")))
    prior = F.col("n") / F.lit(float(texts.count())) * F.lit(mass)

    def log_odds(c: str) -> Column:
        a = F.col(c) + prior
        return F.log(a / (F.lit(total[c] + mass + 0.5) - a))

    odds = (everywhere.withColumn("odds", log_odds("n1") - log_odds("n0"))
            .withColumn("sd", F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior)))
            .filter((F.col("odds") >= LEAST_ODDS) & (F.col("odds") / F.col("sd") >= Z))
            .join(candidates.select("id", "form"), "id").select("form", "odds"))
    model = Model({r["form"]: float(r["odds"]) for r in odds.collect()})  # some forms of the sample's texts
    sent = model.to_json()

    # the sample again: how words of clean texts score, then the evidence of each text
    def spectrum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, seen = Model.from_json(sent), Counter()
        for df in batches:
            for text in df["text"]:
                found = words_of(text)
                hits = [round(s, 2) for _, s in m.hits(found)]
                seen.update(hits)
                seen[-m.drift] += len(found) - len(hits)
        yield pd.DataFrame([(float(s), n) for s, n in seen.items()], columns=["score", "n"])

    clean = chosen.filter("_toxic = 0").mapInPandas(spectrum, "score double, n long")
    spread = clean.groupBy("score").agg(F.sum("n").alias("n")).toPandas()  # a row for each hundredth at most
    top = max(model.odds.values(), default=1.0)
    # a clean word in a thousand million has the best score, so that lam exists without any hit
    scores = np.append(spread["score"].to_numpy(dtype=float), [top, -model.drift])
    weights = np.append(spread["n"].to_numpy(dtype=float), [1e-9 * max(1.0, spread["n"].sum()), 1.0])
    model.lam = rate(scores, weights)
    sent = model.to_json()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model.from_json(sent)
        for df in batches:
            yield pd.DataFrame({"x": [round(m.evidence(t), 3) for t in df["text"]], "y": df["_toxic"]})

    points = (chosen.mapInPandas(weigh, "x double, y int").groupBy("x")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).toPandas())
    # one point for each thousandth of evidence and label, as often as it occurs
    x = np.repeat(points["x"].to_numpy(dtype=float), 2)
    y = np.tile([1.0, 0.0], len(points))
    n = np.column_stack([points["hits"], points["n"] - points["hits"]]).ravel().astype(int)
    model.curve = fit_curve(np.repeat(x, n), np.repeat(y, n))
    return model


def score_column(model: Model, text: str | Column) -> Column:
    """The score of a text as a column (Arrow batches; the model is a broadcast of bounded size)."""
    sent = model.to_json()

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model.from_json(sent)
        for a in texts:  # few texts are Python objects at a time
            yield pa.array([m.score(t) for at in range(0, len(a), 256) for t in a.slice(at, 256).to_pylist()], pa.float64())

    return score(text)


def passages_column(model: Model, text: str | Column) -> Column:
    """array<struct<first, last, score, chance>>: the significant segments of a text, in words."""
    sent = model.to_json()

    @F.pandas_udf("array<struct<first:int,last:int,score:double,chance:double>>")
    def passages(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model.from_json(sent)
        for s in texts:
            yield s.map(lambda t: [{"first": a, "last": b - 1, "score": v, "chance": c}
                                   for a, b, v, c in m.passages(t)], na_action=None)

    return passages(text)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = learn(docs, labels, sample)
    return (docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"),
                        score_column(model, F.col("text").cast("string")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
