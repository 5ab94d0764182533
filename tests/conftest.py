from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("QUILLSPARK_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillspark.session import local_session

    session = local_session(shuffle_partitions=4, memory="4g", **{"spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri()})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not os.path.isdir(SMALL):
        pytest.skip("no test data here")
    return SMALL
