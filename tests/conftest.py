import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from compare import make_spark

    s = make_spark("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
