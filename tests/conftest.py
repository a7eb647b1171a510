import pytest

from lexiloom import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
