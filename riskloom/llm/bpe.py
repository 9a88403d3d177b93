"""Byte-level BPE encoding and decoding of whole texts (operator 5).

Method: overlapping chunk encoding.  A text is cut into chunks that overlap
a little; every chunk is pre-tokenised on its own, in parallel.  A chunk that
starts inside a word begins with a wrong pre-token, but the pre-tokeniser has
no memory beyond the current match: as soon as the left chunk's boundaries
and the right chunk's boundaries meet once inside the overlap, they agree
from there on.  The chunks are stitched at that point and the pieces encoded
by rank-ordered byte-pair merges, all new short pieces of a slice of texts
at a time.  Decoding concatenates the raw bytes of the
ids.

An overlap always ends behind a letter, a single space and a letter, or behind
a letter or digit and a punctuation mark or symbol other than an apostrophe.  Every
pre-tokenisation of a text has a boundary in front of such a space, and between the letter
or digit and such a mark, so the two sides meet there at the latest: stitching never fails
and no word is too long for it (an overlap grows until it holds such a place or
the text ends).  Scripts without spaces and code meet at their marks; what has
neither, like a run of one letter, is one pre-token and cannot be divided.

Defined results: a null text is the empty text; the empty text has no ids
and decodes to no bytes; repeated rows are encoded each on their own; extra
columns are carried along.  Characters that are not valid in UTF-8 cannot
occur in a Spark string read from Parquet text.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, ready

#: Characters of a chunk, and of the overlap with its right neighbour.
CHUNK, OVERLAP = 32_768, 256
#: Pieces a worker remembers, in two generations: when the younger is full it becomes the older one, of which only
#: pieces that come again are kept.  Results do not depend on it.
MEMORY = 80_000
#: Whole texts that are Python objects at a time, and whose new pieces are merged together.
SLICE = 128
#: Bytes up to which new pieces are merged together; a longer one is merged alone.
SHORT = 64
#: A boundary lies in front of the space, or of the mark, in any pre-tokenisation.
_MEETING = regex.compile(r"\p{L} \p{L}|[\p{L}\p{N}][[\p{P}\p{S}]--['\u2019]]", regex.V1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, leftmost on ties.

    Pairs wait in a heap, parts in a linked list, so a piece of n bytes takes
    n log n steps also when it is very long.
    """
    import heapq

    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))          # part at i spans piece[i:end[i]]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue                      # one of the two parts has merged meanwhile
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i:end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Pairs:
    """All pairs of tokens that are a token together, to merge many short pieces at a time."""

    NONE = np.int64(1 << 62)

    def __init__(self, ranks: dict[bytes, int]):
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        found = [(a << 32 | b, rank) for token, rank in ranks.items() for k in range(1, len(token))
                 if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        table = np.array(found, dtype=np.int64).reshape(-1, 2)
        table = table[np.argsort(table[:, 0])]
        self.keys, self.ranks = table[:, 0].copy(), table[:, 1].copy()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs of tokens are together, ``NONE`` where they are no token."""
        if not len(self.keys):
            return np.full(len(left), self.NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces (none empty): as ``merge_piece``, one merge of each piece in a round."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        pair = np.full(len(ids), self.NONE)  # rank of the token at a place with the next one of its piece
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        pair[inside] = self.rank(ids[inside], ids[inside + 1])
        ended = []
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(pair, starts)
            counts = np.diff(starts, append=len(ids))
            going = np.repeat(least < self.NONE, counts)
            if not going.all():
                ended.append((owner[~going], ids[~going]))
                owner, ids, pair = owner[going], ids[going], pair[going]
                continue
            hits = np.flatnonzero(pair == np.repeat(least, counts))
            at = hits[np.searchsorted(hits, starts)]  # the leftmost of each piece
            ids[at] = least
            stays = np.ones(len(ids), dtype=bool)
            stays[at + 1] = False
            owner, ids, pair = owner[stays], ids[stays], pair[stays]
            at = at - np.arange(len(at))  # one place of each piece before is gone
            pair[at] = self.NONE
            again = np.concatenate([at, at[at > 0] - 1])
            again = again[again + 1 < len(ids)]
            again = again[owner[again] == owner[again + 1]]
            pair[again] = self.rank(ids[again], ids[again + 1])
        owner = np.concatenate([o for o, _ in ended])
        packed = np.concatenate([i for _, i in ended])[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Coder:
    """Pre-token text -> packed ids (little-endian unsigned 32 bit), and back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs = Pairs(ranks)

    def piece(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            ids = merge_piece(text.encode("utf-8", "surrogatepass"), self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= 64:
            self.known[text] = packed
        return packed

    def forget(self) -> None:
        """Between texts: makes the younger generation the older one when it is full."""
        if len(self.known) >= MEMORY // 2:
            self.older = self.known.copy()
            self.known.clear()

    def pieces(self, texts: list[str]) -> bytes:
        self.forget()
        known, piece = self.known, self.piece
        return b"".join([known.get(t) or piece(t) for t in texts])

    def meet(self, pieces: set[str]) -> None:
        """Remembers pieces, of which the short new ones are merged together."""
        known, new = self.known, []
        for text in pieces:
            if text not in known and len(text) <= SHORT:
                if (packed := self.older.get(text)) is not None:
                    known[text] = packed
                elif len(piece := text.encode("utf-8", "surrogatepass")) <= SHORT:
                    if (rank := self.ranks.get(piece)) is not None:
                        known[text] = struct.pack("<I", rank)
                    else:
                        new.append((text, piece))
        if new:
            texts, packed = zip(*new, strict=True)
            known.update(zip(texts, self.pairs.merge(packed), strict=True))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        self.forget()
        found = [self.find(t) for t in texts]
        self.meet(set().union(*found))
        known, piece = self.known, self.piece
        return [b"".join([known.get(t) or piece(t) for t in pieces]) for pieces in found]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The worker's coder for a vocabulary file (read once per worker)."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def chunk_spans(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the overlapping chunks of a text; a short text is one chunk.

    Neighbours overlap by at least ``overlap`` characters, the last two of
    which enclose a meeting place; where the text has none, the chunk runs to
    the end of the text.
    """
    spans, start, n = [], 0, len(text)
    while n - start > chunk + overlap:
        found = _MEETING.search(text, start + chunk + overlap - 3)
        if found is None:
            break
        spans.append((start, found.end()))
        start = found.end() - overlap
    spans.append((start, n))
    return spans


def encode_chunk(c: Coder, text: str, tail: int) -> tuple[list[str], int]:
    """Pre-tokens of one chunk up to where it meets its neighbour, and that offset in the overlap.

    ``tail``: characters shared with the right neighbour (0: the last chunk).
    """
    if not tail:
        return c.find(text), 0
    base = len(text) - tail
    found = [(m.start(), m.group()) for m in c.iterate(text)]
    mine = {at for at, _ in found if at >= base}
    meet = min(m.start() for m in c.iterate(text[base:]) if m.start() + base in mine)
    return [t for at, t in found if at < base + meet], meet


def encode_text(c: Coder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """All of the above for one text in one place (tests and short texts)."""
    spans = chunk_spans(text, chunk, overlap)
    if len(spans) == 1:
        return c.pieces(c.find(text))
    out, skip = [], 0
    for (a, b), following in [*pairwise(spans), (spans[-1], None)]:
        body, meet = encode_chunk(c, text[a:b], b - following[0] if following else 0)
        out.append(c.pieces(_from(body, skip)))
        skip = meet
    return b"".join(out)


def _from(pieces: list[str], skip: int) -> list[str]:
    """The pieces that begin at offset ``skip`` or later."""
    at = 0
    for k, t in enumerate(pieces):
        if at >= skip:
            return pieces[k:]
        at += len(t)
    return []


def _summary(packed: bytes, c: Coder, with_ids: bool) -> tuple:
    decoded = c.decode(packed)
    return (packed if with_ids else None, len(packed) // 4, hashlib.sha256(packed).hexdigest(),
            hashlib.sha256(decoded).hexdigest())


_SUMMARY = pa.struct([("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _slices(texts: pa.Array) -> list[pa.Array]:
    """A batch in parts of few texts (one at least), so that few are Python objects at a time."""
    return [texts.slice(at, SLICE) for at in range(0, max(1, len(texts)), SLICE)]


def _summaries(texts: pa.Array, c: Coder, with_ids: bool) -> pa.Array:
    rows = [_summary(ids, c, with_ids) for ids in c.texts(texts.to_pylist())]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_SUMMARY)
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SUMMARY, strict=True)], fields=list(_SUMMARY))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", with_ids: bool = True,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df`` without its text, with ``ids`` (packed little-endian unsigned 32 bit, null if not
    asked for), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``vocabulary``: path of a rank file that every executor has; ``pattern``: the pre-tokeniser.
    Texts of one chunk are encoded where they are read.  The chunks of longer texts are dealt out
    over the cluster, encoded there, and only their ids meet again, text by text.
    """
    spark = ready(df.sparkSession)
    others = [c for c in df.columns if c != text]
    clash = [c for c in others if c.lower() in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    others = [c for c in others if c not in clash]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row, tx = fresh(others, "row"), fresh(others, "txt")
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias(row), body.alias(tx)) \
        if others else df.select(F.lit(None).cast("string").alias(row), body.alias(tx))
    limit = chunk + overlap
    out = "struct<ids:binary,n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"

    @F.arrow_udf(out)
    def whole(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = coder(vocabulary, pattern)
        for a in texts:
            yield pa.concat_arrays([_summaries(few, c, with_ids) for few in _slices(a)])
        a = None
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks without the batches' memory

    short = source.filter(F.length(tx) <= limit).select(row, whole(tx).alias("enc"))

    @F.pandas_udf("array<struct<no:int,tail:int,part:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t):
            spans = chunk_spans(t, chunk, overlap)
            starts = [a for a, _ in spans[1:]] + [None]
            return [{"no": k, "tail": 0 if s is None else b - s, "part": t[a:b]}
                    for k, ((a, b), s) in enumerate(zip(spans, starts, strict=True))]
        return texts.map(one)

    @F.pandas_udf("struct<ids:binary,meet:int,skips:array<int>,at:array<int>>")
    def chunk_ids(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        c = coder(vocabulary, pattern)
        for part, tail in parts:
            rows = []
            for t, k in zip(part, tail, strict=True):
                pieces, meet = encode_chunk(c, t, int(k))
                c.forget()
                c.meet(set(pieces))
                # the left neighbour says later how much of the head is its own: ids in front of each
                # boundary of the head
                skips, at, chars, ids, head = [], [], 0, 0, 4 * overlap + 64
                for p in pieces:
                    skips.append(chars)
                    at.append(ids)
                    if chars > head:
                        break
                    chars += len(p)
                    ids += len(c.known.get(p) or c.piece(p))
                else:
                    skips.append(chars)
                    at.append(ids)
                rows.append((c.pieces(pieces), meet, skips, at))
            yield pd.DataFrame(rows, columns=["ids", "meet", "skips", "at"])

    @F.pandas_udf(out)
    def stitched(chunks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(vocabulary, pattern)
        for s in chunks:
            rows = []
            for parts in s:
                packed, skip = [], 0
                for x in sorted(parts, key=lambda x: x["no"]):
                    cut_at = dict(zip(x["c"]["skips"], x["c"]["at"], strict=True))[skip] if skip else 0
                    packed.append(bytes(x["c"]["ids"])[cut_at:])
                    skip = x["c"]["meet"]
                rows.append(_summary(b"".join(packed), c, with_ids))
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    # a key for each long row: its content, and a running number for rows that are the same
    key = F.struct(F.monotonically_increasing_id().alias("n"), F.xxhash64(tx).alias("h"))
    long = (source.filter(F.length(tx) > limit).withColumn("key", key)
            .select(row, "key", F.explode(cut(tx)).alias("x"))
            .select(row, "key", "x.no", "x.tail", "x.part")
            .repartition(partitions(spark), F.xxhash64("key.h", "no"))
            .select(row, "key", "no", chunk_ids("part", "tail").alias("c"))
            .groupBy("key").agg(F.min_by(row, "no").alias(row),
                                F.collect_list(F.struct("no", "c")).alias("all"))
            .select(row, stitched("all").alias("enc")))
    both = short.unionByName(long)
    return both.select(*[F.col(row)[c].alias(c) for c in others], "enc.*")
