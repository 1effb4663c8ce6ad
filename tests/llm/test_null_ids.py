from quandrel.llm import jaccard


def test_unlike_rows_of_a_null_id_all_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, a), (None, b), ("", c), (None, c), ("7", a + " more")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = sorted((r.doc_id is None, r.doc_id or "", r.text) for r in jaccard.keep_one(docs).collect())
    assert kept == [(False, "", c), (False, "7", a + " more"), (True, "", b)]
    kept = [r.text for r in jaccard.keep_one(docs.filter("doc_id is null")).collect()]
    assert sorted(kept) == [a, b, c]
