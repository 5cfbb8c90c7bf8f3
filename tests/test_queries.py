"""Every registered query against its SQL on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

from netsift.plans import catalogue
from netsift.plans.tables import TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("check", os.path.join(ROOT, "tools", "check.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
catalogue.load()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    _, text = check.compare(spark, con, name, DATA)
    assert not text.startswith("FAIL"), text
    assert "CROSS" not in text, text


def test_entry_module():
    spec = importlib.util.spec_from_file_location("entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert set(entry.oracle_sql()) <= set(entry.queries())
