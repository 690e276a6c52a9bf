import sys
from pathlib import Path

import pytest
from hypothesis import settings

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

# The same examples in each run.
settings.register_profile("fixed", derandomize=True, deadline=None)
settings.load_profile("fixed")


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_spark

    s = get_spark("tests", "local[4]", 4)
    yield s
    s.stop()
