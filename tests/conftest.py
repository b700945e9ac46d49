import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from clauseweave.plans.session import local_session

    s = local_session(cores=4, partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    for d in ("/root/testdata/sf0.001",):
        if Path(d).exists():
            return d
    pytest.skip("no test data here")
