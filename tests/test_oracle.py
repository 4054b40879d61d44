"""Every query with an oracle gives the same whole result on both engines."""

import os

import pytest

import compare
from veritab.plans import QUERIES

ROOT = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.duck(ROOT)


@pytest.mark.parametrize("name", QUERIES.names())
def test_query(spark, con, name):
    entry = QUERIES.get(name)
    _, rows, verdict = compare.compare(spark, con, ROOT, name, entry.fn, entry.oracle)
    assert verdict in ("ok", "no oracle"), verdict
    if entry.oracle is None:
        assert rows > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 13
    assert set(QUERIES.names()) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
