import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dqspark.session import get_session
    ckpt = tempfile.mkdtemp(prefix="dqspark-test-ckpt-")
    s = get_session("local[4]", shuffle_partitions=8, app_name="dqspark-tests",
                    extra={"spark.checkpoint.dir": ckpt})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, order=None):
    """Collect as a list of dicts (sorted by ``order`` columns when given)."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple((r[c] is None, r[c]) for c in order))
    return out
