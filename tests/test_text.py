"""Chunking, nearest neighbours and policy sources."""

import numpy as np

from conftest import SF_MID
from riskloom.operators.chunking import chunk_documents, split_text
from riskloom.operators.retrieval import nearest_neighbors
from riskloom.plans.model_queries import _covered
from riskloom.sources.files import read_policies
from riskloom.sources.tables import read_table


def test_split_on_paragraphs_without_overlap():
    text = "a" * 27 + "\n\n" + "b" * 290 + "\n\n" + "c" * 189
    chunks = split_text(text, 500, 50)
    assert [len(c) for c in chunks] == [319, 189]


def test_documents_chunks_cover_text(spark):
    docs = read_table(spark, SF_MID, "documents").select("doc_id", "text")
    chunks = chunk_documents(docs).toPandas()
    assert (chunks["chunk"].str.len() <= 500).all()
    texts = dict(docs.toPandas().values)
    for doc_id, g in chunks.sort_values("chunk_id").groupby("doc_id"):
        assert _covered(texts[doc_id], list(g["chunk"]))
        assert list(g["chunk_id"]) == list(range(len(g)))


def test_nearest_neighbors_matches_brute_force(spark):
    emb = read_table(spark, SF_MID, "embeddings").select("vec_id", "embedding")
    got = nearest_neighbors(emb, emb, "vec_id", "vec_id", k=3, query_block=64, corpus_block=100,
                            exclude_self=True).toPandas()
    pdf = emb.toPandas()
    m = np.stack(pdf["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    ids = pdf["vec_id"].to_numpy()
    d2 = ((m[:, None, :] - m[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    for i, q in enumerate(ids):
        order = np.lexsort((ids, d2[i]))[:3]
        exp = list(ids[order])
        g = got[got.vec_id == q].sort_values("rank")
        assert list(g["neighbor_id"]) == exp


def test_read_policies(spark, tmp_path):
    (tmp_path / "p1.txt").write_text("RULES\n\nline one\nline two")
    (tmp_path / "p2.txt").write_text("OTHER\n")
    rows = read_policies(spark, str(tmp_path)).collect()
    assert len(rows) == 2
    assert sorted(r.text for r in rows) == ["OTHER\n", "RULES\n\nline one\nline two"]
