import pytest

from compare import duck, session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(tiny):
    return duck(tiny)
