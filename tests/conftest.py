import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

from fathomline.session import build_session, ensure_workers_import


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, 4)
    ensure_workers_import(session)
    yield session
    session.stop()
