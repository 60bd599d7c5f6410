import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxmill.session import session

    s = session("local[4]", 4, spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
