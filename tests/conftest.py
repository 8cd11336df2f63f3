import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from heliofleet.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, "heliofleet-tests", **{"spark.checkpoint.dir": shared})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
