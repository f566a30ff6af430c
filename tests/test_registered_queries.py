"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
import compare  # noqa: E402
from fleetspark.plans import all_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    message, _ = compare.compare(spark, connection, FOLDER, name)
    assert message is None


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_of_the_library_has_sql():
    assert set(all_queries().queries) == set(all_queries().sql) | {"request_results_json"}


def test_a_query_without_sql_is_not_equal(spark, connection, monkeypatch):
    monkeypatch.setattr(contract, "oracle_sql", dict)
    assert compare.compare(spark, connection, FOLDER, "asset_preview")[0] == "it has no SQL"


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
