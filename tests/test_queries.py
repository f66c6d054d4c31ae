"""Every registered query of the library's own operators against DuckDB on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from gleaner import catalogue  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in catalogue.SQL:
        result = duck.execute(catalogue.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(df.columns, rows) == canonical(names, result.fetchall())


def test_entry_and_oracles_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
