"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf_dir, name):
    assert not compare(spark, con, sf_dir, name).startswith("DIFF")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "filename", "ext", "size", "modified", "score", "snippet"]
    rows = df.collect()
    assert len(rows) == 50 and all("<b>the</b>" in r.snippet.lower() for r in rows)
