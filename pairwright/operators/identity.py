"""Function identities, the function universe and overlap between inputs
(SURVEY P6, P7, A5-A7, U1-U3).

Two identities exist and are never mixed:

* A, string identity (folder, file, begin, end): used by the split generator
  and the n-way overlap check;
* B, typed identity (file, start int, end int), folder ignored: used by the
  pairwise overlap check.  "012" and "12" are the same start here, and a
  cell that is not an integer raises (ANSI cast), as the reference does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.schema import FUNC_COLS, LEFT, RIGHT


def _side(cols: Sequence[str], names: Sequence[str] = FUNC_COLS):
    return F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names)])


def function_ids(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Both functions of every pair as rows (P6): one scan, ``inline`` of a 2-array."""
    return df.select(*keep, F.inline(F.array(_side(LEFT), _side(RIGHT))))


def function_universe(df: DataFrame) -> DataFrame:
    """Distinct functions over both sides of all pairs."""
    return function_ids(df).distinct()


def typed_function_ids(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Identity B (P7): (file, start int, end int); a bad integer raises."""
    def side(f, b, e):
        return F.struct(F.col(f).alias("file"), F.col(b).cast("int").alias("start"),
                        F.col(e).cast("int").alias("end"))
    return df.select(*keep, F.inline(F.array(side("file1", "begin1", "end1"),
                                               side("file2", "begin2", "end2"))))


def unique_functions(df: DataFrame, by: Sequence[str] = ("src",)) -> DataFrame:
    """Number of distinct typed functions per input."""
    return (typed_function_ids(df, keep=by).distinct().groupBy(*by)
            .agg(F.count(F.lit(1)).alias("unique_functions")))


def overlap_pairwise(first: DataFrame, second: DataFrame) -> DataFrame:
    """Typed functions present in both inputs (U1); ``overlap_list`` sorts them."""
    return (typed_function_ids(first).intersect(typed_function_ids(second))
            .select("file", "start", "end"))


def overlap_list(first: DataFrame, second: DataFrame) -> DataFrame:
    """The common functions sorted by file, then start and end as numbers (K7)."""
    return overlap_pairwise(first, second).orderBy("file", "start", "end")


def overlap_sizes(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: distinct typed functions of each input and of both.

    One aggregation per function with two flags, then three counts; no set leaves the executors.
    """
    both = (typed_function_ids(first).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
            .unionByName(typed_function_ids(second).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))))
    per = both.groupBy("file", "start", "end").agg(F.max("_a").alias("a"), F.max("_b").alias("b"))
    return per.agg(F.count_if(F.col("a") == 1).alias("n_first"), F.count_if(F.col("b") == 1).alias("n_second"),
                   F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"))


def overlap_nway(df: DataFrame, src: str = "src") -> DataFrame:
    """Functions that occur in more than one input, with the sorted inputs.

    One aggregation per function: ``collect_set`` is combined map-side, and a
    set holds at most one entry per input, so even a function that occurs in
    a third of all rows yields a list no longer than the number of inputs.
    """
    g = (function_ids(df, keep=[src]).groupBy(*FUNC_COLS)
         .agg(F.array_sort(F.collect_set(src)).alias("files")))
    return (g.withColumn("n_files", F.size("files"))
            .filter(F.col("n_files") > 1))
