import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpus_cases import CLASHING, table  # noqa: E402


@pytest.fixture
def empty(spark):
    return table(spark, [], CLASHING)
