import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quarrylens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=8, **{"spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
