import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tetrad.session import get_session
    s = get_session("local[4]", app="tetrad-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tools.oracle_check import duck as mk
    return mk(SF_SMALL)


@pytest.fixture()
def tmp_dir(spark):
    import uuid
    from tetrad.session import scratch_path
    return scratch_path(spark, f"test-{uuid.uuid4().hex}")
