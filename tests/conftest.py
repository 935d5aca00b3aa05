"""One local session for all tests."""

import pytest

from marlstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    yield local_session(cores="4", partitions=4, memory="4g")
