import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from packetgrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Set scale limits for one test, so the split paths run on small data."""
    names = []

    def set_(**values):
        for name, value in values.items():
            key = f"packetgrain.{name}"
            names.append(key)
            spark.conf.set(key, str(value))

    yield set_
    for key in names:
        spark.conf.unset(key)
