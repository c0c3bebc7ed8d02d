import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from inkwell.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
