"""Columns that carry the names an operator uses inside pass through it."""

from quandrel.llm import decontaminate, line_dedup

LONG = "A line that is long enough to count as a key here"


def test_decontaminate_keeps_columns_of_its_own_names(spark):
    names = ["own_id", "own_row", "hit_id", "hit_row", "row_hash", "_id", "window_id", "words"]
    docs = spark.createDataFrame([(1, "a b c", *names), (2, "z", *names)], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == [*docs.columns, "n_words", "n_hit", "item_ids", "contaminated"]
    assert {(r.doc_id, r.n_hit, *(r[n] for n in names)) for r in got.collect()} == {(1, 2, *names), (2, 0, *names)}
    assert got.select(*docs.columns).count() == 2


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    names = ["of_doc", "of_row", "bitmap", "row_hash", "lines", "slice"]
    docs = spark.createDataFrame([(i, LONG + f"\nx{i}", *names) for i in range(6)], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.dedup_lines(docs)
    assert {(r.doc_id, r.kept_text, *(r[n] for n in names)) for r in got.collect()} == {*((i, f"x{i}", *names) for i in range(5)), (5, LONG + "\nx5", *names)}
    assert got.select(*docs.columns).count() == 6
