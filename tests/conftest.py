import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL
