import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("PAIRWRIGHT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pairwright.session import get_spark
    return get_spark("local[4]", shuffle_partitions=8, extra={"spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="pairwright-ckpt-")})


@pytest.fixture(scope="session")
def sf():
    return SF


DOCS = "doc_id long, text string, fp string, h long, length int"


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, null ids, repeated rows, ties, one long text, columns whose names clash."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    line = "A line that is long enough to be counted as one, really"
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, long), (5, long), (None, "no id at all"), (None, None),
            (6, " \n \n"), (7, "x " * 25), (8, "ünï cödé ẞ 你好 \U0001f600 mixed"), (9, long + " tail")]
    rows += [(10 + i, f"{line}\n  {line.upper()} \nown {i}") for i in range(6)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
