import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from docquarry.session import local_session

    session = local_session("8", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Evaluate expressions over one literal row."""

    def run(*columns):
        return spark.range(1).select(*columns).collect()[0]

    return run
