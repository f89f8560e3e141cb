import pytest

from footprints.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", "4g")
