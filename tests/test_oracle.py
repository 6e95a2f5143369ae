"""Each query of the catalogue against its twin in SQL, over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from placewise.plans.oracle import ORACLE_SQL
from placewise.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in [*TABLES, "labels"]:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(row):
    return tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in row)


def test_all_have_twins():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    kinds = {c[0]: str(c[1]) for c in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    order = [names.index(c) for c in columns]
    want = sorted((same(r[i] for i in order) for r in found.fetchall()), key=repr)
    assert sorted((same(r[c] for c in columns) for r in df.collect()), key=repr) == want
