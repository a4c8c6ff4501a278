"""Every query for training data runs on the smallest tables, and agrees with its SQL there."""

import os

import pytest

import __spark_entry__ as entry
from corpusloom.llm import queries as llm
from tests.test_queries import FOLDER, duck, test_query  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables aren't here")
check = test_query.__wrapped__ if hasattr(test_query, "__wrapped__") else test_query
del test_query


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_llm_query(spark, duck, name):  # noqa: F811
    assert name in entry.queries()
    check(spark, duck, name)
