import pytest

from casemill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
