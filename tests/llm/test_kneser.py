import random

import pytest

from quandrel.llm import quality

D = "/root/testdata/sf0.01"


def test_toxic_texts_held_out(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet").filter("lang = 'en'"), spark.read.parquet(f"{D}/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1 and quality = 1 and toxic = 1")
    got = quality.classify(docs, quality.trusted_by_labels(train)).join(held, "doc_id").select("kept").collect()
    assert len(got) >= 8 and sum(x.kept for x in got) <= 0.2 * len(got)


def test_scripts_are_read_and_grouping_equals_broadcasting(spark, monkeypatch):
    r = random.Random(4)
    words = "дорога город вечер книга окно время человек работа слово место голос земля вода школа улица".split()
    text = lambda: " ".join(r.choice(words) for _ in range(60))
    rows = [(i, text(), "ru") for i in range(60)]
    bad = "".join(r.sample(list(text()), 300))
    rows += [(100, text(), "ru"), (101, " ".join("".join(r.sample(w, len(w))) for w in text().split()), "ru"), (102, bad, "ru"), (103, text(), None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in range(60)], "doc_id int")
    a = {x.doc_id: x for x in quality.classify(docs, ids).collect()}
    assert [a[i].kept for i in (100, 101, 102, 103)] == [True, False, False, True] and a[101].perplexity > a[101].threshold
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", 0)
    b = {x.doc_id: x for x in quality.classify(docs, ids).collect()}
    assert a.keys() == b.keys() and all(b[i].kept == a[i].kept and b[i].perplexity == pytest.approx(a[i].perplexity) and b[i].worst_word == pytest.approx(a[i].worst_word) for i in a)
