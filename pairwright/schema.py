"""Column layout of a labelled pair table.

A pair row names two functions, each as (folder, file, begin, end), and a
class label.  All nine cells are strings, as they are in the CSV files the
tables come from; ``row_pos`` is the 0-based position of the row in its
input (file order) and ``src`` the input it came from.
"""

from pyspark.sql import types as T

LEFT = ("folder1", "file1", "begin1", "end1")
RIGHT = ("folder2", "file2", "begin2", "end2")
FUNC_COLS = ("folder", "file", "begin", "end")
PAIR8 = LEFT + RIGHT
PAIR_COLS = PAIR8 + ("label",)

PAIR_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in PAIR_COLS])
PAIR8_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in PAIR8])

# Class labels exactly as written in the files; anything else is neither class.
CLONE = "1"
NON_CLONE = "0"
