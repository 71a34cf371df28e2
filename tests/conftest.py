import pytest

from gridloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
