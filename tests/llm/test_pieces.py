import os
import random

import pytest

from quandrel.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
sentencepiece = pytest.importorskip("sentencepiece")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def odd_texts():
    r = random.Random(5)
    parts = ["the", "in", "er", " ", "  ", "\n", "1", "23", "é", "ation", "▁", "x", "Th", ".", ",", "q", "€", "😀", "\x00", "ß", "     "]
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return out + ["a" * 1000, "".join(r.choice("abcdefgh") for _ in range(3000)), " " * 200, "▁" * 70, "😀" * 100, ""]


def test_equals_the_library():
    lattice, texts = pieces.Lattice(pieces.load()), odd_texts()
    ids, bounds = lattice.encode(texts)
    want = library().encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_table_encodes_and_comes_back(spark):
    table = pieces.load()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pieces.decode(pieces.encode(docs, table), table).collect()
    assert [r.ids for r in rows] == library().encode([r.text for r in rows])
    assert all(r.decoded == r.text for r in rows)


def test_decode_equals_the_library(spark):
    table, r = pieces.load(), random.Random(6)
    lists = [[r.randrange(3, 32000) for _ in range(r.randint(0, 30))] for _ in range(300)]
    rows = pieces.decode(spark.createDataFrame(list(enumerate(lists)), "k int, ids array<int>"), table).collect()
    assert [x.decoded for x in rows] == [library().decode(x.ids) for x in rows]


def test_nulls_empty_table_and_clashing_names(spark):
    table = pieces.load()
    docs = spark.createDataFrame([(1, None, [9]), (1, "", [9]), (2, "a b", None)], "doc_id int, text string, ids array<int>")
    got = pieces.decode(pieces.encode(docs, table), table).collect()
    assert [(x.doc_id, len(x.ids), x.decoded) for x in got] == [(1, 0, ""), (1, 0, ""), (2, 2, "a b")]
    assert pieces.encode(docs.limit(0), table).count() == 0
