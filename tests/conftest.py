import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bindings.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL + 1)
    session = local_session(4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
