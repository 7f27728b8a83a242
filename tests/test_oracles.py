"""Every reference query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from allelic.plans.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def rows(columns, found):
    """Rows with columns by name; floats to nine significant places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", list(queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, map(tuple, df.collect())), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert got == want
