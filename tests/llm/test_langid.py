"""Language by compression: against a plain classifier with the same dictionaries, and on held-out rows."""

import zlib

import zstandard
from llm.helpers import ODD, SF, odd_documents, write_tables

from riskloom.llm import langid, queries


def plain(model, text):
    """The language of the smallest total, calculated text by text."""
    if not text or not any(c.isalpha() for c in text):
        return "und"
    best = None
    for lang, content in model.dictionaries.items():
        size = 0
        data = text.lower().encode()
        for k in range(0, len(data), langid.SEGMENT):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            c = zstandard.ZstdCompressor(dict_data=d, level=langid.LEVEL, write_content_size=False, write_checksum=False,
                                         write_dict_id=False)
            size += len(c.compress(data[k:k + langid.SEGMENT]))
        if best is None or size < best[0]:
            best = size, lang
    return best[1]


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    right = [r.lang_pred == truth[r.doc_id].lang for r in held]
    assert sum(right) >= 0.98 * len(held)
    taken = [ok for r, ok in zip(held, right) if not r.rejected]
    assert sum(taken) >= 0.99 * len(taken) and len(taken) >= 0.95 * len(held)


def test_equals_plain_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    model = langid.learn(docs)
    assert list(model.dictionaries) and all(len(d) <= langid.DICTIONARY for d in model.dictionaries.values())
    for r in docs.select("text").collect():
        assert model.best(r.text)[0] == plain(model, r.text)


def test_labels_and_ids_are_no_inputs(spark):
    """Other labels, sources and ids of held-out rows change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = "crc32(cast(doc_id as string)) % 4 = 2"
    other = docs.filter(f"NOT ({held})").unionByName(docs.filter(held).selectExpr(
        "doc_id", "text", "'zz' AS lang", "'q' AS source", "0L AS n_chars"))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).collect()} for d in (docs, other))
    assert a == b


def test_odd_rows(spark, tmp_path):
    docs = odd_documents(spark).withColumnRenamed("root", "lang")
    d = write_tables(spark, tmp_path, documents=docs)
    rows = queries.op12_language_id(spark, d).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (3, 4, 5, 11):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[1].lang_pred == "a" and by_id[1].score == 1.0  # one language learnt
    empty = write_tables(spark, tmp_path / "empty", documents=docs.limit(0))
    assert queries.op12_language_id(spark, empty).count() == 0
    none = write_tables(spark, tmp_path / "none", documents=docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in queries.op12_language_id(spark, none).collect()} == {"und"}


def test_a_rare_language_is_learnt(spark):
    common = [(k, f"the cat number {k} sat on the mat with the dog and the bird", "en") for k in range(3000)]
    rare = [(5000 + k, f"der hund nummer {k} schlief unter einem alten baum im garten", "de") for k in range(12)]
    copies = [(10_000 + k, "one text that is there very often in this table", "en") for k in range(3000)]
    docs = spark.createDataFrame(common + rare + copies, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert all(got[i] == lang for i, _, lang in common + rare + copies)
