from __future__ import annotations

import pytest

from stationlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, app="tests", spark__driver__memory="3g")
    yield session
    session.stop()
