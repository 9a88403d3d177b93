"""Tables for the operator tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"

#: Documents with everything awkward: nulls, empties, repeats, ties, a long text, odd characters.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (3, ""),
    (4, None),
    (None, "the quick brown fox jumps over the lazy dog"),
    (None, None),
    (5, "   \t\n "),
    (6, "one"),
    (7, "one two"),
    (8, "word " * 30_000),
    (9, "x" * 50_000),
    (10, "é字🙂 naïve ünïcode ÀÉ mail a@b.co +49 170 1234567 card 4111 1111 1111 1111 ip 10.0.0.1 end"),
    (11, "1" * 20_000 + "." * 20_000 + "@" * 5_000),
]


def odd_documents(spark):
    """The odd documents with extra columns whose names operators might use themselves."""
    rows = [(i, t, k, "a", 1.5, [k]) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest int, root string, score double, key array<int>")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def write_tables(spark, folder, **tables) -> str:
    """The given rows as Parquet tables of a folder, for queries and stages."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
