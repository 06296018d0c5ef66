import tempfile

import pytest

from larkspur.session import local_session


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = local_session(
        4,
        "6g",
        spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=f"{shared}/warehouse",
        spark__sql__shuffle__partitions="4",
        spark__default__parallelism="4",
    )
    yield session
    session.stop()
