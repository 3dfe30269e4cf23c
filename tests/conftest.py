import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from inkstone import session  # noqa: E402
from inkstone.plans import lineage  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.local(4, shuffle_partitions=4, memory="4g")
    yield s
    lineage.forget(s)
    s.stop()
