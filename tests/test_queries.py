"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest

import __spark_entry__ as entry
from barquet import plans
from tests.conftest import SMALL


@pytest.mark.parametrize("name", plans.oracle_sql())
def test_sql(name, same_as_sql):
    same_as_sql(plans.queries()[name], plans.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in plans.queries() if n not in plans.oracle_sql()])
def test_rows(name, spark):
    folder = SMALL.replace("0.001", "0.01") if name.startswith("walk_forward") else SMALL  # the smallest table has too few bars for a window
    rows = plans.queries()[name](spark, folder).count()
    assert rows > 0 or name == "walk_forward"  # none of its candidates is robust on random prices


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and -100 <= rows[0]["score"] <= 100


def test_names():
    assert set(plans.oracle_sql()) <= set(entry.queries())
