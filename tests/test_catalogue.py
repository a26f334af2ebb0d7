"""Every query with SQL gives the rows of that SQL; those without give rows."""

import datetime
import decimal
import time
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    out = catalogue.QUERIES[name](spark, SF)
    rows = out.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == sorted(out.columns)
    assert bag(out.columns, rows) == bag(want.columns, want.fetchall())


def test_ecc_query(spark):
    rows = catalogue.QUERIES["ecc_roundtrip"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.p_name == r.repaired and 0 < r.errors <= 16 for r in rows)


def test_ecc_values_on_many_rows(spark):
    """Every value has errors. Decoded one by one these 20,000 took about two minutes, together about a second."""
    sf = "/root/testdata/sf0.1"
    began = time.monotonic()
    rows = Counter(map(tuple, catalogue.QUERIES["ecc_values"](spark, sf).select("p_partkey", "repaired", "in_bounds").collect()))
    assert time.monotonic() - began < 40
    assert rows == Counter(duckdb.sql(f"SELECT p_partkey, p_name, TRUE FROM '{sf}/part.parquet'").fetchall())
