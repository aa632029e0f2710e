"""One small Spark session for all tests."""

import pytest

from codeloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.adaptive.enabled": "true"})
    yield session
    session.stop()


