"""One local session for all tests, with a shared folder of its own."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vectrail.session import session

    folder = tmp_path_factory.mktemp("spark")
    s = session("local[4]", 4, spark__checkpoint__dir=f"file://{folder}/checkpoints", spark__sql__warehouse__dir=f"{folder}/warehouse", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
