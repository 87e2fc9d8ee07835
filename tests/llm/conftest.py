import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import edge  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    from cellgrid.llm.common import prepare

    prepare(spark)
    return edge.table(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return edge.empty(spark)
