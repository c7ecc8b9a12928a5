import os

import pytest

os.environ.setdefault("QUERN_DRIVER_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quern.session import build_session

    session = build_session(8, "quern-tests")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
