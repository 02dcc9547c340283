import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hearthgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session("hearthgrid-tests", cpus=8, spark__checkpoint__dir=shared)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
