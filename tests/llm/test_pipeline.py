import importlib.util

import pytest

from quandrel.llm import quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


def test_stages_against_brute_force(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    one = c.STAGES[0][1](spark, docs, SF)
    assert one.columns == docs.columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert all(kept[i] == rows[i].text for i in kept)
    wrong = [i for i, x in labels.items() if i in rows and (i in kept) != (x.quality == 1)]
    assert len(wrong) <= 0.15 * len(labels)

    two = c.STAGES[1][1](spark, one, SF)
    holders: dict[str, set] = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for i, t in kept.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    texts = {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in kept.items()}
    got = {r.doc_id: r for r in two.collect()}
    assert {i: r.text for i, r in got.items()} == texts and all(r.n_chars == len(r.text) for r in got.values())

    three = c.STAGES[2][1](spark, two, SF)
    from tests.llm.test_operators import brute_groups

    ids = sorted(texts)
    root = brute_groups([texts[i] for i in ids], 5, 80)
    keep = {i for n, i in enumerate(ids) if root[n] == n or not texts[i].split()}
    assert {r.doc_id for r in three.collect()} == keep

    four = c.STAGES[3][1](spark, three, SF)
    left = {r.doc_id for r in four.collect()}
    assert left < keep and four.columns == docs.columns
    last = c.STAGES[4][1](spark, four, SF).collect()
    assert {r.doc_id for r in last} == left and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.filter("doc_id % 2 = 0"), {r.doc_id: r for r in labels.filter("doc_id % 2 = 1").collect()}
    kept = {r.doc_id: r.kept for r in quality.classify(docs, quality.trusted_by_labels(train)).collect()}
    good = [kept[i] for i, x in held.items() if i in kept and x.quality == 1 and x.toxic == 0]
    bad = [kept[i] for i, x in held.items() if i in kept and x.quality == 0]
    assert sum(good) >= 0.93 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_quality_odd_rows(spark):
    rows = [(1, "the cat sat on the mat. " * 5, "en"), (2, None, "en"), (3, "", None), (1, "%%% $$$ " * 20, "en"), (None, "the cat sat on a mat.", "xx")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id int, text string, lang string, perplexity double")
    ids = spark.createDataFrame([(1,), (1,), (None,)], "doc_id int")
    got = quality.classify(docs, ids).collect()
    assert len(got) == 5 and [x.kept for x in got if x.doc_id in (2, 3)] == [False, False]
    assert all(x.kept for x in quality.classify(docs.filter("text > ''"), ids.limit(0)).collect())
    assert quality.classify(docs.limit(0), ids).count() == 0
