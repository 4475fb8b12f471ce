"""Every registered query against its DuckDB oracle on the smallest tables."""
import pytest

from narralytics.catalog import load_all
from tests.oracle import compare, connect

ENTRIES = load_all()
# no text of the smallest tables meets these narrow conditions
MAY_BE_EMPTY = {"unknown_labels", "source_intersection", "shared_test_sources", "duplicate_keys"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, con, sf_dir, name):
    problem = compare(spark, con, ENTRIES[name], sf_dir)
    assert not problem or (problem == "both empty" and name in MAY_BE_EMPTY)


def test_entry_point(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
