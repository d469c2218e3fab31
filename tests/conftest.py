import pytest

from pairlight.session import local_session
from pairlight.ship import ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", 4)
    ship(s)
    yield s
    s.stop()
