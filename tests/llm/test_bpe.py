"""Byte-level BPE against the public library."""

import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm.helpers import ODD, SF, empty_documents, odd_documents

from riskloom.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_query_equals_library(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_byte_bpe(spark, SF).collect()}
    want = {r.doc_id: expected(library, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == want


def test_chunks_meet(library, ranks):
    c = bpe.Coder(ranks, PATTERN)
    rng = random.Random(5)
    parts = ["ab", "é", " ", "  ", "\n", "9", "12", "!", "'s", "'re", "字", "🙂", " the", "xyz" * 3]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))
        ids = library.encode_ordinary(text)
        assert bpe.encode_text(c, text, chunk=40, overlap=16) == struct.pack(f"<{len(ids)}I", *ids)


def test_text_without_meeting_place_is_one_chunk():
    assert bpe.chunk_spans("x" * 1000, 40, 16) == [(0, 1000)]


def test_scripts_without_spaces_and_code_are_divided(spark, library):
    rng = random.Random(9)
    script = "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃") * rng.randint(1, 4) + rng.choice(["", "", "，", "。", "「"]) for _ in range(400_000))
    code = "".join(rng.choice(["f(x)", "a=b;", "'s", "don't", "9+1", "[k]", "\n", "if(y){", "}", "0x1f", "’s"]) for _ in range(60_000))
    assert len(script) > 10**6
    for text in (script, code):
        spans = bpe.chunk_spans(text)
        assert len(spans) > len(text) // 50_000 and max(b - a for a, b in spans) < 2 * bpe.CHUNK
    df = spark.createDataFrame([(1, script), (2, code)], "doc_id long, text string")
    for r in bpe.encode(df, PATH, PATTERN).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, script if r.doc_id == 1 else code)


def test_round_trip_and_odd_rows(spark, library, ranks):
    out = bpe.encode(odd_documents(spark), PATH, PATTERN, chunk=1000, overlap=64)
    rows = out.collect()
    assert out.columns == ["doc_id", "digest", "root", "score", "key", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    c = bpe.Coder(ranks, PATTERN)
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.digest][1] or ""
        assert c.decode(bytes(r.ids)) == text.encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, text)


def test_empty_table(spark):
    assert bpe.encode(empty_documents(spark), PATH, PATTERN).count() == 0


def test_merges_of_long_piece(library, ranks):
    for text in ("a" * 3000, "ab" * 1000 + "c", "z"):
        assert bpe.merge_piece(text.encode(), ranks) == library.encode_ordinary(text)


def test_few_texts_are_python_objects_at_a_time(ranks, monkeypatch):
    """A batch of whole texts is encoded in slices; the rows are the same and in their order."""
    texts, sizes = [f"text {k} é字" * (k % 5) for k in range(1_000)], []
    summary = bpe._summaries
    monkeypatch.setattr(bpe, "SLICE", 64)
    c = bpe.Coder(ranks, PATTERN)
    parts = [(sizes.append(len(x)), summary(x, c, True))[1] for x in bpe._slices(pa.array(texts))]
    assert max(sizes) == 64 and sum(sizes) == 1_000
    got = [tuple(r.values()) for r in pa.concat_arrays(parts).to_pylist()]
    assert got == [bpe._summary(c.pieces(c.find(t)), c, True) for t in texts]
    assert len(summary(bpe._slices(pa.array([], pa.string()))[0], c, True)) == 0


def test_few_pieces_are_remembered(library, ranks, monkeypatch):
    """A worker remembers two generations of pieces at most; frequent ones stay, the ids are the same."""
    monkeypatch.setattr(bpe, "MEMORY", 40)
    c = bpe.Coder(ranks, PATTERN)
    for k in range(200):
        text = f"the frequent words and {k} x{k * 7919} y{k * 104729}"
        ids = library.encode_ordinary(text)
        assert c.pieces(c.find(text)) == struct.pack(f"<{len(ids)}I", *ids)
        assert len(c.known) + len(c.older) <= 2 * (20 + len(ids)) and " frequent" in c.known


def test_new_pieces_of_a_slice_are_merged_together(library, ranks, monkeypatch):
    """No short piece is merged alone; ids and remembered pieces are as ever."""
    rng = random.Random(11)
    parts = ["ab", "é", " ", "  ", "\n", "9", "!", "'s", "字", "🙂", " the", "xyz", "thonre", "q", "\u3000", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "z" * 200 + " aaaa"]
    alone = []
    merge = bpe.merge_piece
    monkeypatch.setattr(bpe, "merge_piece", lambda piece, r: (alone.append(piece), merge(piece, r))[1])
    c = bpe.Coder(ranks, PATTERN)
    for _ in range(2):
        for text, ids in zip(texts, c.texts(texts), strict=True):
            want = library.encode_ordinary(text)
            assert ids == struct.pack(f"<{len(want)}I", *want) and c.decode(ids) == text.encode()
    assert all(len(p) > bpe.SHORT for p in alone)
    assert c.pairs.merge([b"ab", b"thonre", b"q", b"aaaaa"]) == [
        struct.pack(f"<{len(x)}I", *x) for x in (merge(p, ranks) for p in (b"ab", b"thonre", b"q", b"aaaaa"))]
    few = {bytes([b]): b for b in range(256)}  # a vocabulary without any pair
    assert bpe.Coder(few, PATTERN).texts(["ab"]) == [struct.pack("<2I", 97, 98)]
