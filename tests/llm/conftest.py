"""Small documents with the difficult cases, shared by the tests of this folder."""

import pytest

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The documents table with nulls, empty and long texts, repeated rows, and columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    long = "word " * 9000 + "end"
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t "), (10**6 + 3, long), (10**6 + 4, long), (10**6 + 5, "only four words here"), (10**6 + 6, "only four words here"), (10**6 + 7, "Only FOUR words here"), (None, "no id at all but quite some words in this text"), (10**6 + 8, "twice"), (10**6 + 8, "twice")]
    rows = base.unionByName(spark.createDataFrame(extra, SCHEMA))
    clash = ("key", "n", "s", "path", "length", "kept", "rules", "ids", "item_id", "score", "grp", "match")
    return rows.select("doc_id", "text", *(F.lit("x").alias(c) for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
