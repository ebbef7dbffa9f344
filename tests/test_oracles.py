"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest
from compare import connect, difference

from wordtrail import plans

SQL = plans.all_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, con, name):
    assert difference(plans.all_queries()[name](spark, folder), con, SQL[name]) is None


def test_every_section_is_covered():
    ids = {name.split("_")[0] for name in plans.all_queries()}
    sizes = {"s": 15, "p": 15, "j": 3, "g": 8, "w": 7, "o": 4, "u": 3, "m": 8, "f": 35, "t": 23, "v": 13,
             "l": 15, "e": 18, "c": 5}
    assert {f"{letter}{i}" for letter, n in sizes.items() for i in range(1, n + 1)} <= ids


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
