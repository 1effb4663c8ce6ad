"""What encoding and decoding hold at once."""

import importlib.util
import os
import random
import tracemalloc

import pyarrow as pa
import pytest

from quandrel.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary here")
pytest.importorskip("sentencepiece")


def workers(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_one_worker_a_task_encodes_and_decodes(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", None), (2, "a  b ▁€\n", "y")], "doc_id int, text string, decoded string")
    table = pieces.load()
    got, want = pieces.encode(docs, table, decoded="decoded"), pieces.decode(pieces.encode(docs, table), table)
    assert got.schema == want.schema and got.collect() == want.collect()
    assert (workers(got), workers(want)) == (1, 2)


def test_the_query_takes_one_worker_a_task(spark):
    assert workers(pieces.op6_sentencepiece(spark, "/root/testdata/sf0.001")) == 1


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_the_stage_takes_one_worker_a_task_and_sends_texts_once(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id int, text string, decoded string")
    rows = c.tokens(spark, docs, "")
    assert workers(rows) == 1
    assert [(r.doc_id, r.decoded, r.n_tokens, r.round_trip) for r in rows.collect()] == [(1, "x", 2, True), (2, "y", 0, True)]
    sent = rows._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert "AS document" in sent and "struct(doc_id" in sent and "text, text#" not in sent
    alone = c.tokens(spark, docs.select("text"), "")
    assert alone.columns == ["ids", "n_tokens", "round_trip"] and alone.count() == 2


def test_a_batch_of_many_words_takes_little_memory():
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(200)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    lattice = pieces.Lattice(pieces.load())
    lattice.encode(texts[:1])
    tracemalloc.start()
    n = sum(x.num_rows for x in pieces.encoded(lattice, batch, pieces.decoding(pieces.load())))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert n == len(texts) and peak < 100
