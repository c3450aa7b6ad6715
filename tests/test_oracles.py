"""Every registered query against its SQL."""

import pytest

from plumbline import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF) >= 0
