import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetrisk.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="fleetrisk-tests", shuffle_partitions=4)
    yield s
    s.stop()


def rows(df, *cols):
    """Collect selected columns as a list of tuples (small frames only)."""
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
