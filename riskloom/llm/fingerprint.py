"""Document fingerprints (operator 9), with DataFrame functions only.

Method: a homomorphic multiset hash.  Every paragraph (a line of the text)
hashes to a wide vector, and a text's fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo powers of two.  So the order of
paragraphs does not matter, equal texts have equal fingerprints, and
``combine`` adds or takes away paragraphs without the text.

A paragraph's vector has two parts:

* 8 lanes modulo 2**62 hashed from the whole paragraph with 8 seeds: equality
  of multisets of paragraphs;
* 126 lanes modulo 2**32 that count, for each of 126 hash bits, the pieces of
  the paragraph (all its runs of three words, each word but the last two
  begins one; a paragraph of one or two words is one piece) whose bit is set,
  and one lane that counts the pieces.  ``2 * count - pieces`` is a sum of random signs, so the
  cosine of two such vectors estimates the share of pieces two texts have in
  common.  A text of Spark has less than 2**31 characters, so no lane of a
  text wraps; of texts taken together by ``combine`` the lanes do beyond 2**31 pieces.

Three 21-bit fields of a long hold three lanes, so one sum over the exploded
pieces adds three lanes in generated code.

Defined results: a null text is the empty text; the empty text's lanes are
all 0; two equal fingerprints have likeness 1, an empty text and another one 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, same

IDENTITY_LANES, LANES, FIELDS = 8, 126, 3
PACKED = LANES // FIELDS
FIELD_BITS, LANE_BITS, IDENTITY_BITS = 21, 32, 62
#: Pieces summed at most before lanes are reduced (a 21-bit field holds more).
BLOCK = 1 << 19
#: Group 1: the three words from the start of a word on, or a paragraph of fewer (without white space before it).
PIECE = (r"(?<!\S)(?=(\S++[^\S\n]++\S++[^\S\n]++\S++"
         r"|(?<![^\n])\S++(?:[^\S\n]++\S++)?+(?=[^\S\n]*+(?:\n|\z))))")
INDENT = r"(?<![^\n])[^\S\n]++"


def _identity(text: Column) -> list[Column]:
    paragraphs = F.filter(F.split(text, "\n", -1), lambda p: p != "")
    top = (1 << IDENTITY_BITS) - 1

    def lane(k: int) -> Column:
        return F.aggregate(paragraphs, F.lit(0).cast("long"),
                           lambda acc, p: (acc + F.xxhash64(F.lit(k), p).bitwiseAND(top)).bitwiseAND(top))

    return [lane(k) for k in range(IDENTITY_LANES)]


def _packed_sums(piece: Column) -> list[Column]:
    """42 sums: field f of long s counts the pieces whose hash has bit 21 * f + s set."""
    ones = sum(1 << (FIELD_BITS * f) for f in range(FIELDS))
    half = PACKED // 2
    return [F.sum(F.shiftright(h, s).bitwiseAND(ones)).alias(f"_s{half * j + s}")
            for j, h in enumerate(piece) for s in range(half)]


def _lanes(packed: Column) -> Column:
    """The 126 lanes of 42 packed longs."""
    mask = (1 << FIELD_BITS) - 1

    def field(f: int) -> Column:
        return F.transform(packed, lambda x: F.shiftrightunsigned(x, FIELD_BITS * f).bitwiseAND(mask))

    return F.concat(*[field(f) for f in range(FIELDS)])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of two texts taken together (sign 1), or of a text without the paragraphs of another (-1)."""
    def add(x: Column, y: Column, bits: int) -> Column:
        return (x + sign * y).bitwiseAND((1 << bits) - 1)
    return F.struct(F.zip_with(a["identity"], b["identity"], lambda x, y: add(x, y, IDENTITY_BITS)).alias("identity"),
                    F.zip_with(a["lanes"], b["lanes"], lambda x, y: add(x, y, LANE_BITS)).alias("lanes"),
                    add(a["pieces"], b["pieces"], LANE_BITS).alias("pieces"))


def to_string(fp: Column) -> Column:
    """Hex of all lanes: identity, lanes, number of pieces."""
    def lane_hex(x: Column, width: int) -> Column:
        return F.lpad(F.lower(F.hex(x)), width, "0")
    return F.concat(F.array_join(F.transform(fp["identity"], lambda x: lane_hex(x, 16)), ""),
                    F.array_join(F.transform(fp["lanes"], lambda x: lane_hex(x, LANE_BITS // 4)), ""),
                    lane_hex(fp["pieces"], LANE_BITS // 4))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of the signed lanes of two fingerprints, 1 if they are equal."""
    def signed(fp: Column) -> Column:
        return F.transform(fp["lanes"], lambda x: (2 * x - fp["pieces"]).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    sa, sb = signed(a), signed(b)
    size = F.sqrt(dot(sa, sa) * dot(sb, sb))
    cosine = F.when(size > 0, dot(sa, sb) / size).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def fingerprints(df: DataFrame, keys: list[str], texts: dict[str, Column], numbers: list[str] = ()) -> DataFrame:
    """One row for each ``keys`` (which must tell rows apart): struct<identity, lanes, pieces> for
    each of ``texts``; ``numbers``: numeric columns that stay.

    If ``df`` is already dealt out by one of ``keys``, nothing is shuffled.
    """
    names = list(texts)
    rows = df.select(*keys, *numbers, F.posexplode(F.array(*[texts[n] for n in names])).alias("_which", "_text"))
    rows = rows.select(*keys, *numbers, "_which",
                       *[c.alias(f"_i{k}") for k, c in enumerate(_identity(F.col("_text")))],
                       F.regexp_extract_all(F.regexp_replace("_text", INDENT, ""), F.lit(PIECE), F.lit(1)).alias("_pieces"))
    rows = rows.select(*keys, *numbers, "_which", *[f"_i{k}" for k in range(IDENTITY_LANES)],
                       F.posexplode_outer("_pieces").alias("_pos", "_piece"))
    rows = rows.withColumn("_h0", F.xxhash64("_piece")).withColumn("_h1", F.xxhash64(F.lit(1), "_piece"))
    present = F.col("_piece").isNotNull()
    hashes = [F.when(present, F.col(h)) for h in ("_h0", "_h1")]
    sums = (rows.groupBy(*keys, "_which", F.coalesce(F.floor(F.col("_pos") / BLOCK), F.lit(0)).alias("_block"))
            .agg(*[F.max(n).alias(n) for n in numbers],
                 *[F.max(f"_i{k}").alias(f"_i{k}") for k in range(IDENTITY_LANES)],
                 F.count("_piece").alias("_n"), *_packed_sums(hashes)))
    part = F.struct("_which", F.array(*[F.col(f"_i{k}") for k in range(IDENTITY_LANES)]).alias("identity"),
                    _lanes(F.array(*[F.coalesce(f"_s{k}", F.lit(0)) for k in range(PACKED)])).alias("lanes"),
                    F.col("_n").alias("pieces"))
    parts = sums.groupBy(*keys).agg(*[F.max(n).alias(n) for n in numbers], F.collect_list(part).alias("_parts"))

    def one(k: int) -> Column:
        mine = F.filter("_parts", lambda x: x["_which"] == k)
        mask = (1 << LANE_BITS) - 1
        lanes = F.aggregate(mine, F.array_repeat(F.lit(0).cast("long"), LANES),
                            lambda acc, x: F.zip_with(acc, x["lanes"], lambda p, q: (p + q).bitwiseAND(mask)))
        pieces = F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: (acc + x["pieces"]).bitwiseAND(mask))
        return F.struct(mine[0]["identity"].alias("identity"), lanes.alias("lanes"), pieces.alias("pieces"))

    return parts.select(*keys, *numbers, *[one(k).alias(n) for k, n in enumerate(names)])


def _range_of(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below x, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    held = F.lit(bounds)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        at + s <= len(bounds), F.when(F.element_at(held, F.least(at + s, F.lit(len(bounds)))) < x, at + s)
        .otherwise(at)).otherwise(at))


def with_next(df: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with the text of the next one by descending ``order`` (null last; equal ones by the
    text's hash; after the last comes the first).

    Columns: ``bucket`` (ranges of ``order``, a fixed number for each shuffle partition), ``place``
    (in the bucket), ``sentinel``, ``order``, ``text``, ``next``.  Texts move once, to their bucket.
    So that a bucket's last row finds its next one, the head of the following bucket is there too,
    as a sentinel; callers drop those rows when they have used them.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{order}`").cast("long").alias("order"), body.alias("text"))
    n = 4 * partitions(spark)
    # layout only: the ranges' bounds, one for each bucket
    bounds = rows.agg(F.percentile_approx("order", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    # rows without an order may be many: they have buckets of their own, by ranges of the text's hash
    bits = max(1, (n - 1).bit_length())
    ranked = F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    bucket = F.when(F.col("order").isNull(), -1 - ranked).otherwise(_range_of(F.col("order"), sorted(set(bounds))))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    first = rows.groupBy("bucket").agg(F.max("order").alias("order")).collect()  # a row for each bucket
    if not first:
        return rows.select("bucket", F.lit(1).alias("place"), F.lit(0).alias("sentinel"), "order", "text",
                           F.col("text").alias("next"))
    turn = sorted((r["bucket"] for r in first), reverse=True)
    before = dict(zip(turn, [turn[-1], *turn[:-1]], strict=True))
    heads = spark.createDataFrame([(r["bucket"], r["order"], before[r["bucket"]]) for r in first],
                                  "of int, head long, into int")
    # at most 12 rows for each shuffle partition
    found = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("of")) & same(F.col("order"), F.col("head")))
    sentinels = (found.groupBy("into", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
                 .select("order", "text", F.col("into").alias("bucket"), F.lit(1).alias("sentinel")))
    both = rows.withColumn("sentinel", F.lit(0)).unionByName(sentinels)
    w = Window.partitionBy("bucket").orderBy("sentinel", F.desc_nulls_last("order"), F.xxhash64("text"))
    return both.select("bucket", F.row_number().over(w).alias("place"), "sentinel", "order", "text",
                       F.lead("text").over(w).alias("next"))


def fingerprint_pairs(df: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: its fingerprint, that of its edited text, and how near they are to each other
    and to the next row's.

    Edited: the last half of the code points (rounded down) replaced by as many of the next row's first.
    """
    rows = with_next(df, order, text)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("bucket", "place", "sentinel", F.col("order").alias("doc_id"), n.cast("long").alias("n_chars"),
                       "text", edited.alias("edited")).withColumn("sha", F.sha2("edited", 256))
    words = []
    for k in range(8):  # 32 bits each, so that a number can ride along instead of a string
        rows = rows.withColumn(f"sha{k}", F.conv(F.substring("sha", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long"))
        words.append(f"sha{k}")
    prints = fingerprints(rows, ["bucket", "place"], {"mine": F.col("text"), "edit": F.col("edited")},
                          ["sentinel", "doc_id", "n_chars", *words])
    w = Window.partitionBy("bucket").orderBy("place")
    prints = prints.withColumn("following", F.lead("mine").over(w)).filter("sentinel = 0")
    sha = F.concat(*[F.lpad(F.lower(F.hex(c)), 8, "0") for c in words])
    return prints.select("doc_id", "n_chars", sha.alias("edited_sha256"), to_string(F.col("mine")).alias("fingerprint"),
                         to_string(F.col("edit")).alias("edited_fingerprint"),
                         likeness(F.col("mine"), F.col("edit")).alias("near_edited"),
                         likeness(F.col("mine"), F.coalesce("following", "mine")).alias("near_next"))
