import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from galespark.session import local_session

    session = local_session(int(os.environ.get("TEST_CPUS", "8")), "galespark-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
