import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, "tests", **{"spark.driver.memory": "4g"})
    yield session
    session.stop()
