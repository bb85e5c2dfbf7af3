import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from termforge.session import local_session, remove_intermediates

    s = local_session(4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    remove_intermediates(s)
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
