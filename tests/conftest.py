import pytest

from quandrel.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(app="tests", cores=4, memory="4g", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
