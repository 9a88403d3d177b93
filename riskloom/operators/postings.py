"""TF-IDF cosine top-k over posting blocks, with term upper bounds.

Texts are counted where they are read, a batch at a time, into a row of terms and counts for each
document, so neither texts nor words are shuffled; only texts whose id comes again are dealt and sorted by it
before.  That narrow table is written once.  Norms come from one pass over its rows: the most frequent terms,
a bounded list, are sent to every task with their frequencies, and only postings of the other terms, if there
are any, are shuffled by term.  Of each document go on its norm and the counts of those terms that some query has.

Queries of the same terms in the same counts have the same hits: one of each such group is searched
(many questions made from a template differ in numbers only), and every query gets its group's hits.

Blocks of documents meet blocks of queries.  A block holds *posting blocks*, the postings of a
term within it with the maximum of their impact (weight by norm).  A query takes the terms of a
document block by their upper bound (its weight times the maximum), highest first:

* if all upper bounds together stay below the k-th score, the block is skipped;
* once the bounds of the terms that are left do, they are not essential: a document without
  any of the terms before cannot get among the k best, so their postings (those of
  the frequent terms) are read only for documents that still can.

Sums are exact or run in term order, so equal texts score equally however
the data is partitioned; ranks follow the unrounded score, ties the smaller id.
Queries and documents without a common term have no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RETRIEVAL_K
from ..session import parallelism, scratch_path, ship_package, spread

DOC_BLOCK, QUERY_BLOCK = 20_000, 10_000
#: Query blocks are smaller, but not below this, while there are fewer pairs of blocks than cores.
LEAST_QUERY_BLOCK = 2_000
#: At most so many terms, the most frequent ones, are sent to the tasks with their frequencies.
BROADCAST_TERMS = 200_000
#: At most so many ids that come again are broadcast; with more, all texts are dealt by their id.
REPEATED_IDS = 500_000
#: Bytes of text that are counted at once (a longer text is counted alone).
COUNT_BYTES = 8 << 20
#: Powers of two for the whole numbers that a sum of doubles is split into: each of their sums is exact.
LIMBS = (14, 46, 78)
#: Allowance for rounding when a bound decides.
SLACK = 1e-9


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z]+"), "")


def _pieces(texts: pa.Array) -> list[tuple[int, int]]:
    """Runs of rows with about ``COUNT_BYTES`` of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // COUNT_BYTES)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True))


def _word_counts(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Group, term and count of the runs of a-z in lower-case texts, by group; ``texts`` without nulls."""
    ends, data = texts.buffers()[1:]
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    letter = data - np.uint8(97) < 26
    goes_on = np.zeros(len(data) + 1, dtype=bool)  # whether the byte before belongs to the same word
    goes_on[1:] = np.append(letter, False)[:-1] if len(data) else []
    goes_on[ends - ends[0]] = False
    start = np.flatnonzero(letter & ~goes_on[:-1])
    row = np.searchsorted(ends - ends[0], start, side="right") - 1
    place = np.append(np.cumsum(letter, dtype=np.int64)[start] - 1, int(letter.sum()))
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(place), pa.py_buffer(data[letter])).dictionary_encode()
    n = max(1, len(found.dictionary))
    each, counts = np.unique(groups[row].astype(np.int64) * n + found.indices.to_numpy(), return_counts=True)
    return each // n, found.dictionary.take(pa.array(each % n)), counts


def _counted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of id, terms and counts from rows of id and lower-case text that are sorted by id.  The last id
    of a piece is held, as it may go on in the next one."""
    held_id, held = None, Counter()

    def rows(ids: pa.Array, terms: pa.Array, counts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.append(0, ends).astype(np.int32))
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(at, terms.cast(pa.string())),
                                           pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], names)

    def held_row(kind: pa.DataType) -> pa.RecordBatch:
        return rows(pa.array([held_id], kind), pa.array(list(held), pa.string()), np.array(list(held.values())), np.array([len(held)]))

    kind = None
    for batch in batches:
        kind, texts = batch.column(0).type, pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        for a, b in _pieces(texts) if len(texts) else []:
            ids = batch.column(0).slice(a, b - a).dictionary_encode(null_encoding="encode")
            group, terms, counts = _word_counts(texts.slice(a, b - a), ids.indices.to_numpy())
            ids, n = ids.dictionary, len(ids.dictionary)
            first, last = np.searchsorted(group, 1), np.searchsorted(group, n - 1)
            if ids[0].as_py() != held_id and held:
                yield held_row(kind)
                held = Counter()
            held_id, own = ids[0].as_py(), Counter(dict(zip(terms[:first].to_pylist(), counts[:first].tolist(), strict=True)))
            held.update(own)
            if n == 1:
                continue
            if held:
                yield held_row(kind)
            if last > first:
                of, ends = np.unique(group[first:last], return_counts=True)
                yield rows(ids.take(pa.array(of)), terms[first:last], counts[first:last], np.cumsum(ends))
            held_id = ids[n - 1].as_py()
            held = Counter(dict(zip(terms[last:].to_pylist(), counts[last:].tolist(), strict=True)))
    if held:
        yield held_row(kind)


def term_lists(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, tfs) of each document with a word: its lower-case alphabetic runs and how often they are
    there; the texts of rows that share an id (or have none) count together.  The texts are dealt and sorted by id."""
    ship_package(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("tfs", T.ArrayType(T.LongType()))])
    dealt = df.select(id_col, F.lower(text_col)).repartition(id_col).sortWithinPartitions(id_col)
    return dealt.mapInArrow(lambda batches: _counted(batches, schema.names), schema)


def term_lists_in_place(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``term_lists``, of a table that is read several times: only the texts of ids that come again are dealt,
    all others are counted where they are read."""
    ship_package(df.sparkSession)
    ids = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id")
    again = _written(ids, "repeated-ids")
    if again.count() > REPEATED_IDS:
        return term_lists(df, id_col, text_col)
    comes_again, again = F.col(id_col).eqNullSafe(F.col("_id")), F.broadcast(again)
    dealt = term_lists(df.select(id_col, text_col).join(again, comes_again, "left_semi"), id_col, text_col)
    once = spread(df.select(id_col, text_col), factor=1).join(again, comes_again, "left_anti").select(id_col, F.lower(text_col))
    schema = dealt.schema
    return once.mapInArrow(lambda batches: _counted(batches, schema.names), schema).unionByName(dealt)


def postings_of(lists: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf) of rows of id, terms, tfs."""
    each = lists.select(id_col, F.explode(F.arrays_zip("terms", "tfs")).alias("e"))
    return each.select(id_col, F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))


def terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): lower-case alphabetic runs, counted per document."""
    return postings_of(term_lists(df, id_col, text_col), id_col)


# --- one block of documents ---------------------------------------------------

class DocumentBlock:
    """The posting blocks of some documents: of each term places, weights and the greatest impact."""

    def __init__(self, postings: list[tuple[str, np.ndarray, np.ndarray]], ids: np.ndarray, norms: np.ndarray):
        self.ids, self.norms = ids, norms
        self.terms, self.touched = {}, 0
        for term, docs, weights in postings:
            at = np.searchsorted(ids, docs)
            order = np.argsort(at, kind="stable")
            at, weights = at[order], weights[order]
            impact = np.divide(weights, norms[at], out=np.zeros(len(at)), where=norms[at] > 0)
            self.terms[term] = at, weights, float(impact.max())

    def _weights(self, term: str, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For some documents, whether they have the term, and their weight."""
        at, weights, _ = self.terms[term]
        self.touched += min(len(live), len(at))
        k = np.minimum(np.searchsorted(at, live), len(at) - 1)
        has = at[k] == live
        return has, np.where(has, weights[k], 0.0)

    def best(self, query: list[tuple[str, float]], norm: float, k: int, floor: float) -> list[tuple[int, float]]:
        """(document, cosine) of the k best of the block, but none that is surely below ``floor``; ``query``
        in term order."""
        if norm <= 0:  # all cosines are 0: the least ids that share a term
            mine = [self.terms[t][0] for t, _ in query if t in self.terms]
            return [(int(self.ids[d]), 0.0) for d in np.unique(np.concatenate(mine))[:k]] if mine else []
        mine = sorted(((w / norm * self.terms[t][2], t, w) for t, w in query if t in self.terms), reverse=True)
        rest = np.append(np.cumsum([b for b, _, _ in mine][::-1])[::-1], 0.0)  # bound of the terms from each on
        least = floor * (1 - SLACK) - SLACK
        if not mine or rest[0] < least:
            return []
        score, shares = np.zeros(len(self.ids)), np.zeros(len(self.ids), dtype=bool)
        j = 0
        while j < len(mine) and not (rest[j] < least and j):  # essential terms
            _, t, w = mine[j]
            at, weights, _ = self.terms[t]
            self.touched += len(at)
            norms = self.norms[at]
            score[at] += np.divide(weights, norms, out=np.zeros(len(at)), where=norms > 0) * (w / norm)
            shares[at] = True
            j += 1
            if j < len(mine) and shares.sum() >= k:  # the k-th score so far is one more bound
                least = max(least, float(np.partition(score[shares], -k)[-k]) * (1 - SLACK) - SLACK)
        live = np.flatnonzero(shares)
        for b in range(j, len(mine)):
            live = live[score[live] + rest[b] >= least]
            if not len(live):
                return []
            _, t, w = mine[b]
            has, weights = self._weights(t, live)
            norms = self.norms[live]
            score[live] += np.divide(weights, norms, out=np.zeros(len(live)), where=norms > 0) * (w / norm)
            if len(live) >= k:
                least = max(least, float(np.partition(score[live], -k)[-k]) * (1 - SLACK) - SLACK)
        live = live[score[live] >= least]
        # the scores that count, in term order
        dot = np.zeros(len(live))
        for t, w in query:
            if t in self.terms:
                dot += self._weights(t, live)[1] * w
        norms = self.norms[live] * norm
        exact = np.divide(dot, norms, out=np.zeros(len(live)), where=norms > 0)
        return [(int(self.ids[live[i]]), float(exact[i])) for i in np.lexsort((self.ids[live], -exact))[:k]]


def document_block(table: pa.Table, asked: np.ndarray, idf: np.ndarray) -> DocumentBlock:
    """From a row for each document: did, norm, terms, tfs; of them the terms of ``asked`` (ascending), with their ``idf``."""
    lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
    term, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    dids = table.column("did").to_numpy()
    docs = np.repeat(dids, lists[0].value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(asked, term), len(asked) - 1)
    mine = asked[at] == term
    term, docs, weights = term[mine], docs[mine], tfs[mine] * idf[at[mine]]
    order = np.argsort(term, kind="stable")
    term, docs, weights = term[order], docs[order], weights[order]
    names, first = np.unique(term, return_index=True)
    ends = [*first[1:], len(term)]
    postings = [(t, docs[a:b], weights[a:b]) for t, a, b in zip(names.tolist(), first, ends, strict=True)]
    by_id = np.argsort(dids)
    return DocumentBlock(postings, dids[by_id], table.column("norm").to_numpy()[by_id])


# --- Spark ----------------------------------------------------------------------

def limbs_of(x, rint=F.rint) -> list:
    """A double, split into whole numbers of falling units (columns, or arrays with numpy's ``rint``)."""
    parts = []
    for bits in LIMBS:
        parts.append(rint(x * float(1 << bits)))
        x = x - parts[-1] / float(1 << bits)
    return parts


def sum_of_limbs(sums: list[Column]) -> Column:
    total = None
    for bits, s in zip(LIMBS, sums, strict=True):
        part = s / float(1 << bits)
        total = part if total is None else total + part
    return total


def exact_sum(x: Column) -> Column:
    """The sum of doubles, the same in any order of the rows: each value is split into whole numbers of
    falling units, whose sums are exact (up to 2 ** 39, and some million rows)."""
    return sum_of_limbs([F.sum(whole) for whole in limbs_of(x)])


def norms_of(weighted: DataFrame, key: str) -> DataFrame:
    return weighted.groupBy(F.col(key).alias("_key")).agg(F.sqrt(exact_sum(F.col("w") * F.col("w"))).alias("norm"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def query_groups(queries: DataFrame, q_id: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members (q_id, bag), each query with its words in order, and groups (qid, bag), the least id of each bag, written.
    The words of rows that share an id count together; queries without an id or a word have no row."""
    each = queries.filter(F.col(q_id).isNotNull()).select(q_id, words(F.col(text_col)).alias("words"))
    members = (each.groupBy(q_id).agg(F.array_join(F.array_sort(F.flatten(F.collect_list("words"))), " ").alias("bag"))
               .filter(F.col("bag") != ""))
    groups = members.groupBy("bag").agg(F.min(F.col(q_id).cast("long")).alias("qid"))
    return members, _written(groups, "query-groups")


def _weighed(batches: Iterator[pa.RecordBatch], known: pa.Table) -> Iterator[pa.RecordBatch]:
    """From rows of did, terms, tfs: did, the limbs of the sum of squared weights over the ``known`` terms (term, idf, n),
    and the numbers and counts of those of them that are asked."""
    names, idf = known.column("term").combine_chunks(), known.column("idf").to_numpy()
    number = known.column("n").to_numpy()
    for b in batches:
        terms, tfs = (b.column(c) for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(b)), terms.value_lengths().to_numpy(zero_copy_only=False))
        flat = terms.flatten()
        at = pc.fill_null(pc.index_in(flat, value_set=names.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
        doc, tf, at = doc[at >= 0], tfs.flatten().to_numpy(zero_copy_only=False)[at >= 0], at[at >= 0]
        w = tf * idf[at]
        sums = [np.bincount(doc, whole, len(b)) for whole in limbs_of(w * w, np.rint)]
        asked = number[at] >= 0
        ends = pa.array(np.append(0, np.cumsum(np.bincount(doc[asked], minlength=len(b)))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [b.column("did"), *[pa.array(x, pa.float64()) for x in sums], pa.ListArray.from_arrays(ends, pa.array(number[at[asked]])),
             pa.ListArray.from_arrays(ends, pa.array(tf[asked], pa.int32()))], ["did", "s0", "s1", "s2", "terms", "tfs"])


def weighted_documents(lists: DataFrame, vocabulary: DataFrame, d_id: str) -> DataFrame:
    """(did, norm, terms, tfs) of the documents with asked terms; ``lists``: a row of terms and counts for each document,
    ``vocabulary``: term, df, idf, n (null: not asked)."""
    each_df = vocabulary.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.orderBy(F.col("df").desc()))
    least, lowest = each_df.withColumn("so_far", so_far).agg(
        F.min(F.when(F.col("so_far") <= BROADCAST_TERMS, F.col("df"))), F.min("df")).first()
    frequent = vocabulary.filter(F.col("df") >= F.lit(least)).select("term", "idf", F.coalesce("n", F.lit(-1)).alias("n"))
    known = frequent.toArrow()  # BROADCAST_TERMS rows at most
    rows = lists.select(F.col(d_id).cast("long").alias("did"), "terms", "tfs").filter(F.col("did").isNotNull())
    out = rows.mapInArrow(lambda batches: _weighed(batches, known),
                          "did long, s0 double, s1 double, s2 double, terms array<long>, tfs array<int>")
    rare = lowest is not None and (least is None or lowest < least)
    if rare:
        w = F.col("tf") * F.col("idf")
        asked = F.col("n").isNotNull()
        more = (postings_of(rows, "did").join(F.broadcast(frequent.select("term")), "term", "left_anti")
                .join(vocabulary.filter(F.lit(True) if least is None else F.col("df") < least).drop("df"), "term")
                .select("did", *[x.alias(f"s{k}") for k, x in enumerate(limbs_of(w * w))],
                        F.when(asked, F.array("n")).otherwise(F.array().cast("array<long>")).alias("terms"),
                        F.when(asked, F.array(F.col("tf").cast("int"))).otherwise(F.array().cast("array<int>")).alias("tfs")))
        out = out.unionByName(more)
    if rare or lists.schema[d_id].dataType not in (T.LongType(), T.IntegerType()):  # several rows of a document
        out = out.groupBy("did").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(LIMBS))],
                                     F.collect_list(F.when(F.size("terms") > 0, F.struct("terms", "tfs"))).alias("each")).select(
            "did", "s0", "s1", "s2", F.flatten("each.terms").alias("terms"), F.flatten("each.tfs").alias("tfs"))
    norm = F.sqrt(sum_of_limbs([F.col(f"s{k}") for k in range(len(LIMBS))]))
    return out.filter(F.size("terms") > 0).select("did", norm.alias("norm"), "terms", "tfs")


def search_groups(groups: DataFrame, lists: DataFrame, dfreq: DataFrame, n_docs: int, d_id: str, k: int) -> DataFrame:
    """(qid, rank, d_id, score) of the k best documents of an index for each group of queries: the index's
    (document, terms, tfs) rows, its document frequencies (term, df) and its number of documents."""
    ship_package(lists.sparkSession)
    idf = F.log(F.lit(float(n_docs + 1)) / (F.coalesce(F.col("df"), F.lit(0)) + 1))
    qterms = groups.select("qid", F.explode(F.split("bag", " ")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("tf"))
    # numbers that ascend with the terms
    numbers = _written(qterms.select("term").distinct().orderBy("term").withColumn("n", F.monotonically_increasing_id()), "asked")
    vocabulary = _written(dfreq.join(numbers, "term", "left").select("term", "df", idf.alias("idf"), "n"), "vocabulary")
    qw = (qterms.join(numbers, "term").join(vocabulary.select("term", "df"), "term", "left")
          .select("qid", "n", (F.col("tf") * idf).alias("w"), idf.alias("idf")))
    n_queries, ndb = groups.count(), max(1, math.ceil(n_docs / DOC_BLOCK))
    # documents are copied for each block of queries: as few as their size and the cores allow
    wanted = min(math.ceil(n_queries / LEAST_QUERY_BLOCK), math.ceil(parallelism(lists.sparkSession) / ndb))
    nqb = max(1, math.ceil(n_queries / QUERY_BLOCK), wanted)
    qrows = (qw.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "w", "idf"))).alias("each"))
             .join(norms_of(qw, "qid"), F.col("qid") == F.col("_key"))
             .select("qid", F.col("each.n").alias("terms"), F.col("each.w").alias("weights"), F.col("each.idf").alias("idfs"), "norm"))
    qrep = (qrows.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nqb)).cast("int"))
            .withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(ndb - 1)))))
    drep = (weighted_documents(lists, vocabulary, d_id).withColumn("db", F.pmod(F.xxhash64("did"), F.lit(ndb)).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nqb - 1)))))

    def meet(key, q: pa.Table, d: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and d.num_rows:
            asked, idf = (q.column(c).combine_chunks().flatten().to_numpy() for c in ("terms", "idfs"))
            asked, first = np.unique(asked, return_index=True)
            block = document_block(d, asked, idf[first])
            for few in q.select(["qid", "terms", "weights", "norm"]).to_batches(max_chunksize=500):
                for r in few.to_pylist():
                    query = list(zip(r["terms"], r["weights"], strict=True))
                    out += [(r["qid"], i, s) for i, s in block.best(query, r["norm"], k, 0.0)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("qid", "did", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    found = qrep.groupBy("qb", "db").cogroup(drep.groupBy("qb", "db")).applyInArrow(
        lambda key, q, d: meet(key, q, d), "qid long, did long, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("did"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("qid", "rank", F.col("did").alias(d_id), F.round("score", 6).alias("score")))


def search_terms(queries: DataFrame, lists: DataFrame, dfreq: DataFrame, n_docs: int, q_id: str, d_id: str,
                 text_col: str, k: int) -> DataFrame:
    """(q_id, rank, d_id, score) of the k best documents of an index for every query, each group searched once."""
    members, groups = query_groups(queries, q_id, text_col)
    hits = search_groups(groups, lists, dfreq, n_docs, d_id, k).join(groups, "qid")
    return members.join(hits, "bag").select(F.col(q_id).cast("long").alias(q_id), "rank", d_id, "score")


def indexed(docs: DataFrame, d_id: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The (document, terms, tfs) rows and document frequencies (term, df) of texts, written to the shared work folder."""
    lists = _written(term_lists_in_place(docs, d_id, text_col), "terms")
    return lists, _written(postings_of(lists, d_id).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")


def tfidf_topk(queries: DataFrame, docs: DataFrame, q_id: str = "item_id", d_id: str = "doc_id",
               text_col: str = "text", k: int = RETRIEVAL_K) -> DataFrame:
    """(q_id, rank, doc_id, score): top-k documents by cosine of tf * ln((N+1)/(df+1)), of those that
    share a term with the query; ties broken by id; only the reported score is rounded.

    The (document, term, count) table and the document frequencies are written to the shared work folder.
    """
    return search_terms(queries, *indexed(docs, d_id, text_col), docs.count(), q_id, d_id, text_col, k)
