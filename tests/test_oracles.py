"""Every catalog query against its DuckDB SQL on the smallest tables."""

import importlib.util
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF_DIR = Path("/root/testdata/sf0.001")

import __spark_entry__ as contract  # noqa: E402

spec = importlib.util.spec_from_file_location("check_oracles", ROOT / "tools" / "check_oracles.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

contract.queries()
QUERIES, ORACLES = contract.catalog.QUERIES, contract.catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not SF_DIR.exists():
        pytest.skip("benchmark tables are not here")
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ok, note = check.compare(spark, duck, str(SF_DIR), name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark, duck):
    assert contract.entry(spark).count() > 0
