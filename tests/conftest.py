import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build("tests", "local[4]", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
                                         "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
                                         "spark.ui.enabled": "false", "spark.driver.memory": "4g",
                                         "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
