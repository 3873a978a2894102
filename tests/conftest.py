import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tripframe.session import get_spark
    s = get_spark("local[4]", "tripframe-tests", {"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()
