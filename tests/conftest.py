import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from postloom.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="postloom-tests")
    yield s
    s.stop()
