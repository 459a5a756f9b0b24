import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    # Many small plans and little data: quick compilation beats optimised code.
    session = make_session(java_options="-XX:TieredStopAtLevel=1")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Small frames from tuples: ``table("a int, b string", (1, "x"), ...)``."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build
