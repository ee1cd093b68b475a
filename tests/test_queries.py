"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from mapfold.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(shown, r)) for r in cursor.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want


def test_names_without_sql_run(spark, sf_dir):
    for name in sorted(set(registry.queries()) - set(SQL)):
        assert registry.queries()[name](spark, sf_dir).count() > 0, name
