import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from townhall.session import local_session

    # The tests are their own cluster: the shared folder is a test folder.
    session = local_session("tests", shuffle=4, checkpoints=str(tmp_path_factory.mktemp("rounds")))
    yield session
    session.stop()
