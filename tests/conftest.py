"""One session for all tests; its checkpoints go to a folder of their own."""

import pytest

from codeloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    yield session
    session.stop()
