"""Registered queries of the text operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, centroids, decontaminate, fingerprint, html_text, jaccard, langid, merkle, pii, sharding, substrings,
               toxicity, urls)
from .common import table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of ``documents``: each place but the first, with the documents that keep the text."""
    return substrings.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "start", "end", "n_chunks", "n_words", "first_doc_ids")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text of ``documents``, learnt from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


#: The rules of op3.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning rule and the verdict of every url of ``pages``."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rules_frame(spark, URL_RULES),
                      carry=("page_id",))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, 40).withColumn("law", F.lit("bytes")).withColumn(
        "grown_shard", F.lit(None).cast("int"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as ids of the 50k byte-level vocabulary, and back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda x: x["kind"] < len(pii.BASE))
    kinds = F.transform("pii", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}")
              for k, kind in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                        pii.joined(F.col("pii")).alias("spans"), pii.joined_scores(F.col("pii")).alias("scores"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` inside the texts of ``documents``."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                         table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("doc_hash")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_copies(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, and their likeness."""
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` in a hash tree, with the digest of its proof; every seventh id claims one
    character more than it has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return merkle.prove(docs, ("doc_id", "source", "lang", "n_chars", "text"),
                        where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
                        claimed={"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1})


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learnt from those that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` with its centroid after ten rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP3_SQL = r"""
WITH u AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
    FROM pages),
rules(verdict, rule, h, p) AS (VALUES
    ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/'))
SELECT u.page_id, u.host, u.path, max_by(r.rule, length(r.rule)) AS rule,
       coalesce(max_by(r.verdict, length(r.rule)), 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS n FROM u) u
LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
GROUP BY u.n, u.page_id, u.host, u.path
"""


OP6_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w
           FROM documents),
     b AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w
           FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, hash(text) AS h,
                   unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM d),
     bs AS (SELECT DISTINCT item_id, text,
                   unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM b),
     bn AS (SELECT item_id, text, count(*) AS n FROM bs GROUP BY ALL)
SELECT ds.doc_id, bs.item_id, bn.n AS n_shingles, count(*) AS n_shared, count(*) / bn.n AS containment
FROM ds JOIN bs USING (s) JOIN bn ON bn.item_id IS NOT DISTINCT FROM bs.item_id AND bn.text = bs.text
GROUP BY ds.doc_id, ds.h, bs.item_id, bs.text, bn.n HAVING count(*) >= 0.8 * bn.n
"""


OP11_SQL = r"""
WITH RECURSIVE
rows AS (
    SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars, text,
           coalesce(xor(list_reduce(
               list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
               lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, z: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)::BIGINT),
               4294967295::BIGINT), 4294967295) % 7 = 0, false) AS tampered
    FROM documents),
texts AS (
    SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-')
              || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM rows),
leaves AS (
    SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
           sha256(head || coalesce(strlen((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT)::VARCHAR, '-') || tail) AS claim
    FROM texts),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place,
           count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
nodes(lang, level, idx, digest, n) AS (
    SELECT lang, 0, place, leaf, n FROM placed
    UNION ALL
    SELECT lang, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2
    FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n),
subroots AS (
    SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
    FROM nodes WHERE n = 1),
upper_nodes(level, idx, digest, n) AS (
    SELECT 0, place, subroot, n FROM subroots
    UNION ALL
    SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2
    FROM upper_nodes WHERE n > 1 GROUP BY level, idx // 2, n),
steps AS (
    SELECT p.r, o.level, (p.place >> o.level) % 2 = 1 AS is_right, s.digest AS other
    FROM placed p
    JOIN (SELECT DISTINCT lang, level, n FROM nodes WHERE n > 1) o ON o.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = o.level AND s.idx = xor(p.place >> o.level, 1)
    UNION ALL
    SELECT p.r, 100 + o.level, (t.place >> o.level) % 2 = 1, s.digest
    FROM placed p JOIN subroots t ON t.lang IS NOT DISTINCT FROM p.lang
    JOIN (SELECT DISTINCT level, n FROM upper_nodes WHERE n > 1) o ON true
    LEFT JOIN upper_nodes s ON s.level = o.level AND s.idx = xor(t.place >> o.level, 1)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM steps),
folds(r, k, digest) AS (
    SELECT r, 0, claim FROM placed
    UNION ALL
    SELECT f.r, f.k + 1, sha256(CASE WHEN s.is_right THEN coalesce(s.other, '') || f.digest ELSE f.digest || coalesce(s.other, '') END)
    FROM folds f JOIN ordered s ON s.r = f.r AND s.k = f.k + 1),
folded AS (SELECT r, max_by(digest, k) AS folded_root FROM folds GROUP BY r),
proofs AS (SELECT r, sha256(coalesce(string_agg(other, '' ORDER BY k), '')) AS proof_sha256 FROM ordered GROUP BY r)
SELECT p.doc_id, p.leaf, t.subroot, u.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
       f.folded_root, f.folded_root = u.digest AS verified
FROM placed p JOIN subroots t ON t.lang IS NOT DISTINCT FROM p.lang JOIN folded f ON f.r = p.r
JOIN upper_nodes u ON u.n = 1 LEFT JOIN proofs q ON q.r = p.r
"""


def op13_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds of op13 one after another, each as two tables."""
    nearest = """a{i} AS MATERIALIZED (
    SELECT r, min(distance) AS distance, min_by(k, distance * %d + k) AS k
    FROM (SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{i} c USING (d) GROUP BY v.r, c.k) GROUP BY r)""" % k
    moved = """c{j} AS MATERIALIZED (
    SELECT c.k, c.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
    FROM c{i} c LEFT JOIN (SELECT a.k, v.d, sum(v.x) AS s, count(*)::HUGEINT AS n FROM v JOIN a{i} a USING (r) GROUP BY a.k, v.d) m
    USING (k, d))"""
    steps = [part.format(i=i, j=i + 1) for i in range(rounds) for part in (nearest, moved)]
    last = nearest.format(i=rounds)
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (
    SELECT r, d, floor(1024 * x::DOUBLE)::HUGEINT AS x
    FROM (SELECT r, unnest(embedding) AS x, unnest(range(64)) AS d FROM kept)),
c0 AS MATERIALIZED (
    SELECT s.k, v.d, v.x FROM v JOIN (
        SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS k FROM kept QUALIFY k < {k}) s USING (r)),
{", ".join([*steps, last])},
sums AS (SELECT k, sum(distance) AS s FROM a{rounds} GROUP BY k),
shas AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT kept.vec_id, a.k::INT AS cluster, a.distance::BIGINT AS distance, sums.s::BIGINT AS cluster_inertia,
       (SELECT sum(s) FROM sums)::BIGINT AS inertia, shas.centroid_sha256
FROM kept JOIN a{rounds} a USING (r) JOIN sums USING (k) JOIN shas USING (k)
"""


def registry() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_url_filter, op4_sharding, op5_byte_bpe, op6_decontamination, op7_html_text, op8_jaccard_join, op9_fingerprints, op10_pii, op11_merkle_manifest,
                                   op12_language_id, op13_centroid_clusters)}


def oracle_statements() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op6_decontamination": OP6_SQL, "op11_merkle_manifest": OP11_SQL,
            "op13_centroid_clusters": op13_sql()}
