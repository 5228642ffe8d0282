import pytest

from tracemill import session


@pytest.fixture(scope="session")
def spark():
    return session.local(4, 4)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
