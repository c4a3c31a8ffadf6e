import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from lexigraph.session import Scratch, local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    return Scratch(spark)
