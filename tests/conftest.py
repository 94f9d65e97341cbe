"""Shared Spark session."""

from __future__ import annotations

import pytest

from rollbook.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, shuffle_partitions=8, checkpoints=str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of a column expression over one text, ``x``, and its cell kind, ``k``."""

    def run(expression, value=None, kind=None):
        row = spark.createDataFrame([(value, kind)], "x string, k string").select(expression.alias("v")).first()
        return row["v"]

    return run
