"""Chunks of long texts by several tasks: the same as of one task."""

import random

import pytest

from riskloom.operators import chunking
from riskloom.operators.chunking import chunk_documents, items, split_text, unit_spans, units


def texts(seed, n):
    """Texts of words, lines and blank lines, with repeats, long words and runs of separators."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            if kind < 0.5:
                parts.append("".join(rng.choice("ab ") for _ in range(rng.randint(0, 30))))
            elif kind < 0.6:
                parts.append("x" * rng.randint(1, 80))
            elif kind < 0.75:
                parts.append(rng.choice(["ab cd ", "same "]) * rng.randint(1, 40))
            else:
                parts.append(rng.choice(["\n", "\n\n", "\n\n\n", "\n" * 7, " ", "   "]))
        out.append("".join(parts))
    return out


def by_units(text, size, overlap, longest):
    """All chunks, unit by unit, with the entries that the windows' answers give."""
    out, entry, last = [], None, None
    found = list(units(text, size, longest))
    ends = {run: of[0][3] for run, _, _, of in found if run >= 0}
    for run, a, b, of in found:
        part, run_end = text[a:b], ends.get(run, b)
        if run >= 0:
            first = run != last
            entry, last = a if first else entry, run
            if entry < 0:
                continue
            packing = chunking.Packing(part, of[0][1], of[0][3] - a, b < run_end, size, overlap)
            spans = list(unit_spans(part, a, of, entry, run_end, size, overlap))
            exit_ = packing.exits(first)[entry - a]
            entry = a + exit_ if exit_ >= 0 else -1
        else:
            spans = list(unit_spans(part, a, of, -1, run_end, size, overlap))
        out += [c for c in (part[x:y].strip() for x, y in spans) if c]
    return out


@pytest.mark.parametrize("size, overlap", [(20, 5), (50, 0), (7, 6), (30, 29)])
def test_units_equal_the_whole(size, overlap):
    several = 0
    for text in texts(size, 400):
        for longest in (2 * size, 5 * size):
            assert by_units(text, size, overlap, longest) == split_text(text, size, overlap), (text, longest)
            several += len(list(units(text, size, longest))) > 1
            covered = list(items(text, 0, len(text), 0, size, longest)) if text else []
            assert [a for *_, a, _ in covered[1:]] == [b for *_, b in covered[:-1]]
    assert several > 300


def test_long_documents_equal_short_ones(spark):
    docs = [(k, t) for k, t in enumerate(texts(3, 60))] + [(None, "word " * 300), (100, None), (101, ""), (102, "y" * 5000),
                                                           (103, "word " * 2000), (103, "tok " * 900), (104, "\n" * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in chunk_documents(df, size=60, overlap=11, longest=200).collect()), key=str)
    expected = [(i, k, c) for i, t in docs if t for k, c in enumerate(split_text(t, 60, 11))]
    assert got == sorted(expected, key=str)


def test_one_very_long_document(spark):
    """Ten million characters, in units and windows of several tasks."""
    line = "the quick brown fox jumps over the lazy dog and runs away "
    text = line * 100_000 + "\n" + "z" * 1_000_000 + "\n\n" + "short par\n\n" * 150_000 + line * 40_000
    assert len(text) > 10**7
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = {(run >= 0) for run, *_ in units(text, 500, chunking.LONG)}
    assert kinds == {True, False} and len(list(units(text, 500, chunking.LONG))) > 8
    got = {r.chunk_id: r.chunk for r in chunk_documents(df).collect()}
    assert [got[k] for k in range(len(got))] == split_text(text)
