import pytest

from quandrel.llm import quality

D = "/root/testdata/sf0.1"


@pytest.mark.parametrize("split", [1, 2])
def test_toxic_texts_held_out_in_german_and_french(spark, split):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("lang in ('de', 'fr')").join(labels.select("doc_id").distinct(), "doc_id")
    train, held = labels.filter(f"doc_id % 4 <> {split}"), labels.filter(f"doc_id % 4 = {split} and quality = 1").select("doc_id", "toxic")
    got = quality.classify(docs, quality.trusted_by_labels(train), toxic_ids=quality.toxic_by_labels(train)).join(held, "doc_id").select("lang", "toxic", "kept").collect()
    for lang in ("de", "fr"):
        toxic, clean = ([x.kept for x in got if x.lang == lang and x.toxic == t] for t in (1, 0))
        assert len(toxic) >= 10 and sum(toxic) <= 0.1 * len(toxic)
        assert len(clean) >= 80 and sum(clean) >= 0.9 * len(clean)


def test_a_few_toxic_texts_among_the_trusted_do_not_move_the_limit(spark):
    """Labels are wrong at times: one in forty trusted texts is toxic, and held-out toxic texts still go."""
    import random

    r = random.Random(6)
    parts = ["be", "ge", "ver", "ung", "keit", "lich", "ein", "zu"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    text = lambda bad: " ".join("einzuver" + r.choice(parts) if bad and r.random() < 0.05 else word() for _ in range(150))
    rows = [(i, text(i % 40 == 7), "de") for i in range(200)] + [(i, text(True), "de") for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    ids = lambda lo, hi: docs.filter(f"doc_id >= {lo} and doc_id < {hi}").select("doc_id")
    kept = {x.doc_id: x.kept for x in quality.classify(docs, ids(0, 160), toxic_ids=ids(200, 230)).collect()}
    assert sum(kept[i] for i in range(230, 260)) <= 3 and sum(kept[i] for i in range(160, 200) if i % 40 != 7) >= 34
