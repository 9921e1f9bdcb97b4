import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "netloom-tests", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
