from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    sys.path.insert(0, str(folder))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from logloom.session import local_session

    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
