import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from outagekit.session import checkpoint_dir, get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
