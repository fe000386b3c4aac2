"""pairwright: labelled code-pair datasets as Spark DataFrame jobs.

Sub-packages
------------
sources    readers, writers and the test-data fixtures (pair tables, files)
functions  Column -> Column text and score functions (no Python UDFs)
operators  DataFrame -> DataFrame operators (quality, ranks, splits, fetch,
           renaming, metrics, run history, classification)
plans      the named query catalogue used by ``__spark_entry__`` and bench
streaming  the same operators over a stream of arriving pair files
"""

from pairwright.schema import FUNC_COLS, LEFT, PAIR_COLS, RIGHT  # noqa: F401
from pairwright.session import get_spark  # noqa: F401

__version__ = "0.1.0"
