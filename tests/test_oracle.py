"""Every registered query against its DuckDB SQL on the smallest scale factor
(the driver runs the same comparison at sf0.01; see scripts/oracle_check.py)."""

import duckdb
import pytest

from scripts.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def _keys():
    from puckline.oracle import ORACLE
    return sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_and_is_registered():
    from __spark_entry__ import oracle_sql, queries
    from puckline.oracle import ORACLE
    from puckline.registry import QUERIES
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", _keys())
def test_query_matches_oracle(spark, con, name):
    from puckline.oracle import ORACLE
    from puckline.registry import QUERIES
    df = QUERIES[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    assert s_rows, "an empty result shows nothing"
    res = con.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert rows_of(df.columns, s_rows) == rows_of(d_cols, res.fetchall())


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0 and "goals" in df.columns
