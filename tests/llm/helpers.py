"""Fixtures of the operator tests: real small tables, edge rows, and plain Python versions."""

import os

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ("fp", "anchor", "h1", "norm", "kept", "c0", "runs", "drop", "component_id", "score", "label")


def small(spark, n=120):
    return spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id") < n)


def table(spark, rows):
    """``rows`` of (doc_id, text) as documents with columns whose names clash with those of the operators."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    return docs.withColumn("n_chars", F.length("text").cast("long"))


LONG = " ".join(f"word{i % 997} goes{i % 13}" for i in range(20_000))
EDGES = [
    (1, None), (2, ""), (3, " \n\t\r\n"), (4, "one line of words that comes twice here"), (5, "one line of words that comes twice here"),
    (6, "one line of words that comes twice here"), (6, "one line of words that comes twice here"), (None, "no id at all, but some words"),
    (8, LONG), (9, "é ü\x1cß \x00 \x01 𝄞 ﬁ"), (10, "a"), (11, "a a a a a a a a a a a a a a a a a a a a a a a a a a"),
]


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def has_tables():
    return os.path.isdir(SF)
