"""Every registered query against its SQL over the smallest tables."""

import pytest
from tally import queries as own

SQL = own.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(own.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(own.queries())
