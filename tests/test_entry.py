"""Driver contract: entry(), and every registered query against its DuckDB
oracle on the smallest given tables."""

import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import __spark_entry__ as E  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "avg_words" in df.columns


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert "error" not in r, r
    if name in ORACLE:
        assert r["match"], r
    else:
        assert r["rows"] >= 0


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
                 "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_column_types_match(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in sdf.schema.fields}
    rel = con.sql(ORACLE[name])
    assert st == {c: str(t) for c, t in zip(rel.columns, rel.types)}


def test_entry_schema_is_stable(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema
    assert [f.name for f in a.schema.fields] == ["level", "source", "n_docs", "n_texts", "avg_words",
                                                 "n_chars", "size_mb"]
