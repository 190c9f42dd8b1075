import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from logtide.session import session as make


@pytest.fixture(scope="session")
def spark():
    made = make("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
