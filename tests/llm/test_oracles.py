"""Operators that SQL expresses, against DuckDB on the smallest tables and on odd rows."""

import os

import duckdb
import pytest

from quandrel.llm import registry

SF = "/root/testdata/sf0.001"


def norm(rows, cols, order):
    return sorted((tuple(round(r[cols.index(c)], 6) if isinstance(r[cols.index(c)], float) else r[cols.index(c)] for c in order) for r in rows), key=repr)


def held(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(registry.ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert norm(got, df.columns, sorted(cols)) == norm(cur.fetchall(), cols, sorted(cols))
    return got


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_smallest_tables(spark, name):
    assert held(spark, SF, name)


LONG = "This line is long enough to be a key, and more than that"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    words = [f"w{i}" for i in range(40)]
    texts = [None, "", " \t\n", "one", "one two three", "ONE two three", "\n".join([LONG, "x", f"  {LONG.upper()}\t"]), "É" * 50 + "\nb"]
    texts += ["\n".join([LONG.lower(), str(i)]) for i in range(6)]
    texts += ["é" * 50 + "\n" + "É" * 50] * 4 + [" ".join(words), " ".join(words[:39] + ["other"]), " ".join(words[:30]), " ".join(words[5:]) + " ."]
    texts += [" ".join(["and"] * 500), "x" * 100_000, ("a b c d " * 5000).strip(), "Alpha, beta; GAMMA delta!"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    items = [" ".join(words[3:20]), "alpha beta gamma", None, "", "...", "and and and and and and and and and and and", "One Two Three", "one two three"]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    urls = [None, "", "no-scheme/path", "http://A.Com/en/12?x", "https://example.com/en/1", "https://www.example.com/en/1", "http://x.net/es/", "http://x.net", "http://org/a/b.html#f", "http://h.org//2020-01-02/deadbeef00/x?y", "a://b://c/d", "http://h.org/1/2/3/4/5/6/7/8/9/10", "http://notexample.com/en/9"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[3:6])], "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    v = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.0, 0.0], None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0, 0.0], [-1.0, 0.0], [1e-30, 0.0]]
    rows = [(i, x, 1) for i, x in enumerate(v)] + [(100, [1.0, 0.0], None), (101, [1.0, 0.0], 2), (102, [0.95, 0.3122], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_odd_rows(spark, odd, name):
    assert held(spark, odd, name)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_empty_tables(spark, odd, tmp_path, name):
    for t in ("documents", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).collect() == []
