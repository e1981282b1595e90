import pytest

from relweave import Scale, build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "relweave-tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    """Limits so small that every splitting path runs on a few hundred rows."""
    return Scale(block_rows=40, oversample=8, broadcast_rows=10)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
