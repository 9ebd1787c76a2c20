import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from caseloom.session import build_session

    s = build_session(4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf(request):
    return f"{DATA}/sf0.001"
