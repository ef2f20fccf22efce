import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lexmesh.session import session

    s = session("tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
