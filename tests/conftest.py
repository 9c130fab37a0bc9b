import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lotline.session import get_spark

    s = get_spark("lotline-tests", master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()
