import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
sys.path.insert(0, os.path.dirname(HERE))

SF_SMALL = os.environ.get("PAIRWRIGHT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pairwright.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="pairwright-test-")
