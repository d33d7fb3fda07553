from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from aspectra.session import get_session

    s = get_session(cpus="*", shuffle_partitions=8, app="aspectra-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples, sorted."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
