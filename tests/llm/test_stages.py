"""Pipeline stages on odd rows, on no rows, and beside columns of their own names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

LONG = "This line is long enough to be a key, and more than that"
ITEM = " ".join(f"word{i}" for i in range(14))
NAMES = ["document", "kept_text", "n_lines", "words", "ids_", "root", "a.b", "th"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("stages")
    spark.createDataFrame([("i1", ITEM), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7, *NAMES) for i, t in rows], SCHEMA).repartition(3)


ROWS = [(i, f"{LONG}\nown {i}") for i in range(6)] + [(None, f"{LONG}\nown"), (7, None), (8, ""), (8, ""), (9, f"x {ITEM.upper()} y"), (9, "plain words only"), (None, ITEM), (10, "z" * 300_000), (11, " \t\n")]


def kept(df):
    assert all(r[n] == n for r in df.collect() for n in NAMES)
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_shared_lines(spark, folder):
    out = cp.shared_lines(spark, docs(spark, ROWS), folder)
    assert out.columns == docs(spark, ROWS).columns and out.schema["n_chars"].dataType == docs(spark, ROWS).schema["n_chars"].dataType
    want = [(i, f"own {i}" if i is not None and i < 5 and t.startswith(LONG) else t or "") for i, t in ROWS]
    assert kept(out) == sorted(want, key=repr)
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_benchmark_passages(spark, folder):
    out = cp.benchmark_passages(spark, docs(spark, ROWS), folder)
    assert out.columns == docs(spark, ROWS).columns
    assert kept(out) == sorted(((i, t) for i, t in ROWS if ITEM not in (t or "").lower()), key=repr)


def test_near_copies(spark, folder):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(5, same), (3, same + " more"), (3, same + " more"), (None, same), (8, None), (9, None), (10, "short"), (11, "Short"), (12, "other")]
    out = cp.near_copies(spark, docs(spark, rows), folder)
    assert kept(out) == sorted([(3, same + " more"), (8, None), (9, None), (10, "short"), (12, "other")], key=repr)


def test_tokens(spark, folder):
    rows = [*ROWS[:8], (20, "▁ 中文 é\0"), (21, "  two  spaces ")]
    out = cp.tokens(spark, docs(spark, rows), folder).collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    assert [r.n_tokens for r in out if r.doc_id == 7] == [0]


@pytest.mark.parametrize("stage", [cp.shared_lines, cp.near_copies, cp.benchmark_passages, cp.tokens])
def test_no_rows(spark, folder, stage):
    assert stage(spark, docs(spark, ROWS).limit(0), folder).collect() == []
