import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cleargrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows from a schema string and tuples; row_id is added when absent."""

    def build(schema, rows):
        if "row_id" not in schema:
            schema = "row_id bigint, " + schema
            rows = [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, schema)

    return build
