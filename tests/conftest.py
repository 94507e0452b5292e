import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from vintaloom.session import get_session, ship

    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture(scope="session")
def small():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test data")
    return str(path)
