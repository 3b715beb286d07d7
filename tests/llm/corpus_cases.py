"""Odd tables and helpers of the corpus operators' tests."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside.
CLASHING = ["key", "hash", "place", "m", "n", "i", "bucket", "component_id", "kept", "spans", "quality", "n_lines", "target", "start", "h1"]

LONG = "\n".join(f"line {i % 700} has the words w{i} and w{i * 7 % 1000} in it." for i in range(9000))
RUN = "a" * 150_000
ODD_TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "one two three"),
    (5, "ONE two THREE"),
    (6, LONG),
    (7, RUN),
    (8, "\n\n\n"),
    (9, "é中😀 ﬀ 'S don't 12 345 \x85\u2003 x"),
    (10, "same text that comes twice in the very same table, word for word."),
    (10, "same text that comes twice in the very same table, word for word."),
    (11, "same text that comes twice in the very same table, word for word."),
    (11, "another text under an id that is taken."),
    (None, "a text without an id, but with words enough for a few shingles"),
    (None, None),
    (12, "+1 (187) 555-8851 a@b.example.org 4111 1111 1111 1111, 10.0.0.1 token = \"abcdef0123\""),
]


def table(spark, rows, extra=()):
    """documents with more columns of the given names, all filled."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return frame.select("*", *(F.lit("x").alias(c) for c in extra))


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(rows):
    return {r.doc_id: r for r in rows}
