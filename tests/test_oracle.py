"""Every catalogue query against its DuckDB oracle SQL on sf0.001."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare, duck

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "codigo" in df.columns


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF_SMALL, [name], con=con, verbose=False)[name]
    if name in SQL:
        assert res[0] == "OK", res
    else:
        assert res[0] == "rows-only", res


SPARK_TO_DUCK = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER",
                 "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_output_types_match_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dt = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({SQL[name]}) LIMIT 0").description}
    assert st == dt
