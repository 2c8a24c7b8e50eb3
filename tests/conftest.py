import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from churnlens.plans.session import build_session
    s = build_session(master="local[4]", app="churnlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con01():
    from tests.harness import duck
    return duck(SF01)


@pytest.fixture(scope="session")
def con001():
    from tests.harness import duck
    return duck(SF001)
