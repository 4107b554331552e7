import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from esquina.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture
def hot_rows(spark):
    """Makes keys with more than three rows count as hot."""
    spark.conf.set("spark.esquina.hotRows", "3")
    yield
    spark.conf.unset("spark.esquina.hotRows")
