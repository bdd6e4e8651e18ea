import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from barquet.session import session

    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__execution__arrow__maxRecordsPerBatch="1000")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float) and x == int(x if abs(x) != float("inf") else 0):
        return str(int(x))
    return str(list(x)) if isinstance(x, list | tuple) else str(x)


def as_rows(frame):
    """Rows of a pandas frame, columns by name, as comparable text."""
    import pandas as pd

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(None if x is pd.NA or x is pd.NaT else _plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SMALL).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture
def same_as_sql(spark, duck):
    """Whether a query gives the rows of its SQL on the smallest tables."""

    def check(query, sql):
        got, want = query(spark, SMALL).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert as_rows(got) == as_rows(want)

    return check
