import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from clientlens.session import local_session

    # tests own their shared folder (on a cluster it comes from spark.checkpoint.dir)
    d = tempfile.mkdtemp(prefix="clientlens-test-")
    s = local_session("*", app="clientlens-tests",
                      **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": d})
    yield s
    s.stop()

