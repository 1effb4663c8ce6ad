"""Every query of the catalogue that SQL expresses, against DuckDB on the smallest tables."""

import duckdb
import pytest

from quandrel.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events".split()


def norm(rows, cols):
    order = sorted(cols)
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[cols.index(c)]) for c in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, SF)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(catalogue.ORACLES[name])
    want = norm(cur.fetchall(), [x[0] for x in cur.description])
    assert len(got) == len(want)
    off = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b))]
    assert not off, off[:3]


def test_all_queries_have_a_name_in_the_entry(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
