import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import EDGE, make_documents  # noqa: E402


@pytest.fixture()
def edge(spark):
    return make_documents(spark, EDGE)


@pytest.fixture()
def nothing(spark):
    return make_documents(spark, [])
