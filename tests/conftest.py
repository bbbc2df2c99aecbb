import pytest

from hardwood.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus="8", partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
