import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.core.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(os.environ.get("TEST_CPUS", "8"), "tests", memory="8g")


def rows(df):
    """Sorted list of plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
