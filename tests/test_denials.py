"""From denials to messages, and a caller's vectors to context, against plain code."""

from test_postings import brute, corpus

from riskloom.functions.display import question_text
from riskloom.operators.applications import applications_from_loans
from riskloom.operators.chunking import split_text
from riskloom.plans.denials import denial_context, denial_messages, embedded_context, keyed_chunks
from riskloom.schemas import SYSTEM_TEMPLATE
from riskloom.sources.fixture import raw_loans

HEAD, TAIL = SYSTEM_TEMPLATE.split("{context}")


def applications(spark, n=30):
    return applications_from_loans(raw_loans(spark, "/root/testdata/sf0.001")).filter(f"app_id <= {n}")


def test_messages_equal_plain_retrieval(spark):
    texts, _ = corpus(6, 40)
    words = ["loan", "credit", "grade", "income", "purpose", "employment", "denied", "fico", "term"]
    docs = [(2**44 + i, f"{t} {words[i % 9]} {words[i % 7]}\n\n" + f"why {words[i % 5]} denied {t} " * (i % 30)) for i, t in texts]
    apps = applications(spark)
    chunks = [((i, k), c) for i, t in docs for k, c in enumerate(split_text(t))]
    chunks.sort()
    queries = [(r.app_id, r.q) for r in apps.select("app_id", question_text().alias("q")).collect()]
    best = {}
    for q, rank, number, _ in brute(queries, [(n, c) for n, (_, c) in enumerate(chunks)], 3):
        best.setdefault(q, []).append((rank, chunks[number]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.app_id: r for r in denial_context(apps, df).collect()}
    assert set(got) == {q for q, _ in queries}
    for q, found in best.items():
        assert [(c.doc_id, c.chunk_id) for c in got[q].chunks] == [key for _, (key, _) in sorted(found)]
        assert got[q].context == "\n\n".join(c for _, (_, c) in sorted(found))
    messages = {(r.app_id, r.position): r.content for r in denial_messages(apps, df).collect()}
    for q, text in queries:
        assert messages[(q, 0)] == HEAD + got[q].context + TAIL and messages[(q, 1)] == text


def test_denials_without_a_hit_have_messages(spark):
    apps = applications(spark, 10)
    for rows in ([], [(None, "zzz yyy"), (1, None), (2, "ДА НЕТ")]):
        found = denial_messages(apps, spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(found) == 2 * apps.count()
        assert all(r.content == HEAD + TAIL for r in found if r.position == 0)


def test_chunk_keys_keep_the_order(spark):
    docs = spark.createDataFrame([(2**62, "a b " * 400), (-5, "c d " * 300), (None, "e f"), (7, "g")], "doc_id long, text string")
    rows = keyed_chunks(docs).orderBy("chunk_key").collect()
    names = [(r.doc_id is not None, r.doc_id or 0, r.chunk_id) for r in rows]
    assert names == sorted(names) and len({r.chunk_key for r in rows}) == len(rows) > 5


def test_context_by_a_callers_vectors(spark):
    texts = spark.createDataFrame([(1, "aaa"), (2, "aab"), (3, None), (4, "zzz")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "aaaa"), (2, "zz"), (3, None)], "item_id long, text string")

    def letters(batch):
        return [[float(t.count("a")), float(t.count("z"))] for t in batch]

    got = {r.item_id: r for r in embedded_context(queries, texts, letters, "item_id", "doc_id", k=2).collect()}
    assert got[1].nearest == [1, 2] and got[1].context == "aaa\n\naab"
    assert got[2].nearest == [4, 3] and got[2].context == "zzz"
    assert got[3].nearest == [3, 2] and got[3].context == "aab"
    none = embedded_context(queries, texts.limit(0), letters, "item_id", "doc_id").collect()
    assert [(r.context, r.nearest) for r in none] == [("", [])] * 3
