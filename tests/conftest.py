import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    from trailgrid.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test data")
    return str(path)
