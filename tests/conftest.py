import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from presswell.packaging import ship
    from presswell.session import build_session

    session = build_session(master="local[4]", shuffle_partitions=4, memory="4g", shared=f"file://{tmp_path_factory.mktemp('shared')}")
    ship(session)
    yield session
    session.stop()
