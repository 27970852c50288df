from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from civiccases.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[4]", app="civiccases-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()
