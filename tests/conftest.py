import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskweave.session import build_session

    s = build_session("local[*]", 8)
    if not s.conf.get("spark.checkpoint.dir", None):  # tests only: a scratch checkpoint folder
        d = tempfile.mkdtemp(prefix="rw-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
