import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from strandwise.session import build_session

    return build_session("tests", master="local[8]")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
