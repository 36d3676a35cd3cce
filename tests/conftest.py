import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from provspark.session import get_spark

    s = get_spark("tests", int(__import__("os").environ.get("TEST_CPUS", "4")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
