import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile
    from vectriage.session import get_session
    s = get_session("local[*]", 8, extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="vt-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
