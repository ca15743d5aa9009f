import pytest

from .compare import duck, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def con():
    return duck(SF)
