import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quellwerk import session

    s = session.build("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(session.work_folder(s))
    yield s
    session.clean(s)
