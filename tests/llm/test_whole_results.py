"""The whole results of op1 and op2 against plain code."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from llm.helpers import SF, TINY, write_tables

from riskloom.llm import queries, substrings, toxicity


# --- op1 ---

def plain_cuts(data):
    """Ends of chunks by the rule: one place after another."""
    n, r, gear = len(data), substrings.RADIUS, [int(x) for x in substrings.GEAR]
    h = [sum(gear[data[i - j]] << j for j in range(min(i + 1, substrings.WINDOW))) % 2**32 for i in range(n)]
    ends, tied = set(), []
    for i in range(n):
        near = h[max(0, i - r):i] + h[i + 1:i + r + 1]
        if not near or h[i] < min(near):
            ends.add(i + 1)
        elif h[i] == min(near):
            tied.append(i + 1)
    run = []
    for k, place in enumerate(tied):  # runs of tied places; some of each, whole periods apart
        run.append(place)
        if k + 1 == len(tied) or tied[k + 1] - place > r:
            period = run[1] - run[0] if len(run) > 1 else tied[k + 1] - place if k + 1 < len(tied) else substrings.LONGEST
            ends.update(run[::math.ceil(substrings.TIED / period)])
            run = []
    out, last = [], 0
    for e in sorted(e for e in ends if r < e < n - r) + [n]:
        while e - last > substrings.LONGEST:
            last += substrings.LONGEST
            out.append(last)
        if e > last:
            out.append(e)
        last = e
    return out


def plain_passages(docs):
    """(doc_id, start, end, n_chunks, n_words, first ids) of documents with unique ids."""
    chunks, seen = {}, {}
    for i, text in sorted(docs):
        data, at = text.encode(), 0
        chunks[i] = []
        for e in plain_cuts(data) if data else []:
            seen.setdefault(data[at:e], (i, at))
            chunks[i].append((at, e, data[at:e]))
            at = e
    out = []
    for i, text in docs:
        data, run = text.encode(), []
        begins = [k for k in range(len(data)) if data[k] > 32 and (k == 0 or data[k - 1] <= 32)]
        for at, e, piece in [*chunks[i], (-1, -1, None)]:
            if piece is not None and seen[piece] != (i, at):
                run.append((at, e, seen[piece][0]))
                continue
            if run:
                a, b = run[0][0], run[-1][1]
                words = sum(a <= k < b for k in begins)
                if words >= substrings.LEAST_WORDS:
                    out.append((i, a, b, len(run), words, sorted({f for *_, f in run})))
            run = []
    return sorted(out)


def test_repeated_passages_equal_plain_code(spark, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    docs += [(10**6 + k, t) for k, t in enumerate(["", "spam eggs " * 90, "x" * 1500, "spam eggs " * 70 + docs[3][1][:900],
                                                   docs[5][1], docs[7][1][100:1500] + " end", "ab" * 800 + "é🙂" * 300])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, r.n_chunks, r.n_words, list(r.first_doc_ids))
                 for r in queries.op1_substring_dedup(spark, write_tables(spark, tmp_path, documents=df)).collect())
    want = plain_passages(docs)
    assert got == want and len(want) > 10


# --- op2 ---

def forms(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return words, {f for w in set(words) for f in [w, *[w[:k] + "*" for k in (4, 5, 6) if len(w) > k]]}


def plain_scores(docs, labels):
    """Scores of (id, text) rows from (id, toxic) labels, with the constants of the module."""
    T = toxicity
    label = {}
    for i, t in labels:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            label[i] = max(label.get(i, 0), int(t > 0))
    by_text = {}
    for i, text in docs:
        if i in label:
            least, toxic = by_text.get(text, (i, 0))
            by_text[text] = min(least, i), max(toxic, label[i])
    sample = [(text, toxic) for text, (_, toxic) in by_text.items()]
    n = [sum(toxic == k for _, toxic in sample) for k in (0, 1)]
    counts = [Counter(), Counter()]
    for text, toxic in sample:
        counts[toxic].update(forms(text)[1])
    everywhere = Counter()
    for _, text in docs:
        everywhere.update(forms(text)[1])
    mass = T.PRIOR * sum(n)
    odds = {}
    for f, hits in counts[1].items():
        prior = everywhere[f] / len(docs) * mass
        c = [counts[0][f], hits]
        if sum(c) < 3:
            continue
        a = [x + prior for x in c]
        log = [math.log(x / (m + mass + 0.5 - x)) for x, m in zip(a, n)]
        value, sd = log[1] - log[0], math.sqrt(1 / a[0] + 1 / a[1])
        if value >= T.LEAST_ODDS and value / sd >= T.Z:
            odds[f] = value

    def word_scores(text):
        return [max([odds[f] for f in [w, *[w[:k] + "*" for k in (4, 5, 6) if len(w) > k]] if f in odds], default=-T.DRIFT)
                for w in forms(text)[0]]

    spread = Counter()
    for text, toxic in sample:
        if not toxic:
            spread.update(round(s, 2) if s > 0 else s for s in word_scores(text))
    total, top = sum(spread.values()), max(odds.values())
    spread[top] += 1e-9 * total
    spread[-T.DRIFT] += 1
    lam = T.rate(np.array(list(spread)), np.array(list(spread.values()), dtype=float))

    def evidence(text):
        scores = word_scores(text)
        if not scores:
            return 0.0
        # all maximal segments: the best one, then those left and right of it
        found, todo = [], [(0, len(scores))]
        while todo:
            a, b = todo.pop()
            best, at, low, place = 0.0, None, 0.0, a
            run = 0.0
            for k in range(a, b):
                if run <= 0:
                    run, place = 0.0, k
                run += scores[k]
                if run > best + 1e-12:
                    best, at = run, (place, k + 1)
            if at:
                found.append(best)
                todo += [(a, at[0]), (at[1], b)]
        least = -math.log(-math.log1p(-T.SIGNIFICANT))
        parts = [x for s in found if (x := lam * s - math.log(len(scores))) >= least]
        return math.log1p(sum(parts))

    points = [(round(evidence(text), 3), toxic) for text, toxic in sample]
    a, b = T.fit_curve(np.array([x for x, _ in points]), np.array([float(y) for _, y in points]))
    return {i: 1 / (1 + math.exp(-(a + b * evidence(text)))) for i, text in docs}


def test_scores_equal_plain_code(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None]
    want = plain_scores(docs, labels)
    rows = queries.op2_toxicity(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.3)
    assert len({round(r.score, 6) for r in rows}) > 5
