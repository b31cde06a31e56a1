import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tapeworks.session import local_session

    s = local_session(8, "tests", work=f"file://{tmp_path_factory.mktemp('work')}")
    yield s
    s.stop()
