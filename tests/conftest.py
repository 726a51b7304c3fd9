import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from townloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("townloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.constraintPropagation.enabled", "false")
    yield session
    session.stop()
