import pytest

from lexspark.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=8, shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
