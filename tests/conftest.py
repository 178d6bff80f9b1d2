import os
import sys
from pathlib import Path

# before numpy is loaded: its threads and Spark's would fight over the cores
os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lectern.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()
