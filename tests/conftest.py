import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veilmark.session import local_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8, "6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


def norm(v):
    """A value in a form both engines agree on."""
    if isinstance(v, float):
        return "nan" if v != v else format(v, ".6g")
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    try:
        return format(float(v), ".6g")
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
