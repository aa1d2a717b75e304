import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarrylight.session import local_session, workers_find_us  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", 4, "6g")
    workers_find_us(s)
    yield s
    s.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
