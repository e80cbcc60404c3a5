"""Every query against its SQL on the same tables."""

from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from leafmill.plans.catalog import QUERIES, TABLES
from leafmill.plans.oracle import ORACLE

TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    return con


def test_only_file_sizes_lack_sql():
    assert set(QUERIES) - set(ORACLE) <= {"compact_dataset"}
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, small, duck, name):
    df = queries()[name](spark, small)
    columns = sorted(df.columns)
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    want = Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert Counter(map(tuple, df.select(*columns).collect())) == want
    assert want


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["doc_id", "page_no", "matches", "doc_matches"]
    assert df.count() > 0
