import pytest

from corpusmill.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()
