"""The pipeline: stages in order, each on what the one before kept."""

import hashlib
import os
import struct

import corpus_pipeline
import public_tokenizers
import tiktoken
from llm.helpers import SF, odd_documents, write_tables
from llm.test_decontaminate import brute as contained
from llm.test_near_copy_stage import kept_ids
from llm.test_pii import base_spans

from riskloom.llm import bpe
from riskloom.llm.common import keep, table
from riskloom.session import work_dir


def test_each_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    toxic = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = keep(stage(spark, docs, SF), "t")
        if name != "byte_bpe":
            assert out.schema.names == docs.schema.names
            after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        if name == "toxicity":
            gone = [i for i, _ in before if i not in after]
            right = sum(toxic[i] for i in gone if i in toxic)
            assert right >= 0.8 * sum(i in toxic for i in gone) and right >= 0.6 * sum(toxic.values())
        elif name == "ngram_jaccard_join":
            assert sorted(after) == kept_ids(before)  # five-word shingles, 0.8 or more
        elif name == "benchmark_decontamination":
            dirty = {i for i, *_ in contained(before, items)}
            assert dirty and sorted(after) == sorted(i for i, _ in before if i not in dirty)
        elif name == "pii":
            assert len(after) == len(before)
            for i, t in before:
                spans = base_spans(t)
                assert (after[i] == t) or spans or "[IBAN]" in after[i] or "[SSN]" in after[i]
                assert not any(t[a:b] in after[i] for a, k, b, kind in spans if kind == "email")
        else:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                        mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
            texts = dict(before)
            rows = out.collect()
            assert len(rows) == len(before)
            for r in rows:
                ids = library.encode_ordinary(texts[r.doc_id])
                assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        docs = out
    before = set(os.listdir(work_dir(spark)))
    assert docs.count() == corpus_pipeline.run(spark, SF).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(work_dir(spark))) - before}
    assert left == {"pipeline-3-pii"}  # what the last stage reads


def test_odd_rows(spark, tmp_path):
    d = write_tables(spark, tmp_path, documents=odd_documents(spark),
                     labels=spark.createDataFrame([(1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int"),
                     benchmark=spark.createDataFrame([(1, None), (2, "word word word word word word")], "item_id long, text string"))
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == {1, 3, 4, None, 5, 6, 7, 9, 10, 11}
    empty = write_tables(spark, tmp_path / "empty", documents=odd_documents(spark).limit(0),
                         labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                         benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0
