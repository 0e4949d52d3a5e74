"""Every registered query on the smallest tables, against DuckDB where it has oracle SQL."""

import duckdb
import pytest

from seedloom.plans.registry import TABLES, oracle_queries, spark_queries
from tools.compare import canonical

QUERIES, ORACLE = spark_queries(), oracle_queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE:
        assert len(got) > 0
        return
    a, b = canonical(got), canonical(con.execute(ORACLE[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.values.tolist() == b.values.tolist()
