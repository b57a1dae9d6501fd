"""Every registered query of the core runs, and agrees with its SQL, on the smallest tables."""

import pytest

from tesserae.plans import CATALOGS


def catalogs():
    import importlib

    return [importlib.import_module(c) for c in CATALOGS]


NAMES = sorted(n for c in catalogs() for n in c.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, compare, name):
    f, sql = next((c.QUERIES[name], c.SQL.get(name)) for c in catalogs() if name in c.QUERIES)
    compare(spark, sf, f, sql)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(NAMES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
