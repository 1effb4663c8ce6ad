"""Exact dedup against a dictionary of whole texts, on odd rows, clashing digests and hot classes."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quandrel.llm import exact_dedup

ODD = [(5, "a  b"), (3, "a\t\nb"), (9, "a b"), (9, "a b"), (None, "a b"), (None, "lone"), (None, "lone"), (4, None), (2, ""), (7, " "), (8, "\n \r"), (1, "A b"), (6, "a b"), (10, "x" * 300_000), (11, "x" * 300_000), (12, "x" * 300_001)]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("hot", [1, 2, 1_000])
def test_odd_rows_with_any_share_of_hot_classes(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    assert found(exact_dedup.find_copies(docs)) == brute(ODD)


def test_texts_that_share_a_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digests", lambda t: [(F.length(t) % 2).cast("long").alias("h1"), F.lit(1).cast("long").alias("h2")])
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    assert found(exact_dedup.find_copies(docs)) == brute(ODD)


def test_columns_of_inner_names_pass_through(spark):
    names = ["d1", "d2", "c1", "class_id", "h1", "norm", "hot_0", "a.b", "salt"]
    docs = spark.createDataFrame([(i, "same", *names) for i in range(4)], "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = exact_dedup.find_copies(docs)
    assert got.columns == [*docs.columns, "keep_id", "group_size", "kept", "text_sha256"]
    assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(names)}
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]


def test_no_rows(spark):
    assert exact_dedup.find_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []
