"""Every registered query against its SQL in DuckDB, by the driver's rule: columns
by name, row count, values without order."""

import os

import duckdb
import pytest

from treeline import catalogue
from treeline.plans.inputs import TABLES

DATA = os.environ.get("TREELINE_DATA", "/root/testdata")
SIZE = os.environ.get("TREELINE_SF", "sf0.001")
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(cell(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{SIZE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, f"{DATA}/{SIZE}")
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.execute(catalogue.ORACLES[name])
    columns, kinds = [c[0] for c in rel.description], {c[0]: str(c[1]) for c in rel.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert got == rows(rel.fetchall(), columns)
