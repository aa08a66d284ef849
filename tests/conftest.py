import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barweave.session import local  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local(cpus=8, shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
