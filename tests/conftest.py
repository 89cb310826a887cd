import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanledger import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("spanledger-tests", master="local[8]", shuffle_partitions=4,
                      **{"spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
