"""Every query against its SQL in DuckDB, on the smallest tables."""

import pytest
from conftest import SF
from oracle import connect, differences

from lumenweave.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), ORACLE[name], duck) == []


def test_queries_without_sql_have_value_tests():
    """What SQL can't express is held against plain loops by name in one of the test modules."""
    import pathlib

    text = "".join(p.read_text() for p in pathlib.Path(__file__).parent.glob("test_*.py") if p.name != "test_oracle.py")
    assert [n for n in set(QUERIES) - set(ORACLE) if f'"{n}"' not in text] == []
