import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tesserae.functions.runtime import importable, session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    importable(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


@pytest.fixture(params=["one window", "blocks"])
def ways(request, monkeypatch):
    """Both ways of the sums and places over ordered groups."""
    from tesserae.operators import running

    if request.param == "blocks":
        monkeypatch.setattr(running, "PLAIN_BYTES", 0)
    return request.param


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return v


def _compare(spark, sf, f, sql):
    df = f(spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql is None:
        return
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(sf + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = con.sql(sql)
    names = list(r.columns)
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="session")
def compare():
    """compare(spark, folder, query, sql): runs the query and, if there is SQL, holds its rows against those of DuckDB."""
    return _compare
