import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from veil.functions.lineage import drop_scratch  # noqa: E402
from veil.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4)
    yield session
    drop_scratch(session)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
