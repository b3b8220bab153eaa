import os

import pytest

from tracewright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
