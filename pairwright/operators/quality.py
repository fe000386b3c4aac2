"""Pair-table hygiene: class predicate, balance, duplicates, de-duplication
(SURVEY P4, P11, A1-A4).

All of these are one hash aggregation each, so a row repeated a billion
times is combined map-side before the shuffle; no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.schema import CLONE, NON_CLONE, PAIR_COLS
from pairwright.sources.csv_pairs import CORRUPT, csv_cells


def is_class(label: str = "label"):
    """Label is exactly "1" or "0"; " 1" or "2" are neither class."""
    return F.col(label).isin(CLONE, NON_CLONE)


def class_rows(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(is_class(label))


def class_balance(df: DataFrame, by: Sequence[str] = ("src",), label: str = "label") -> DataFrame:
    """Per input: total (both classes only), clones, non-clones, clone ratio.

    An input whose rows carry no valid label still appears, with total 0 and
    a NULL ratio (the reference prints no ratio then).
    """
    g = df.groupBy(*by).agg(F.count_if(F.col(label) == CLONE).alias("clones"),
                            F.count_if(F.col(label) == NON_CLONE).alias("non_clones"))
    total = F.col("clones") + F.col("non_clones")
    return g.select(*by, total.alias("total"), "clones", "non_clones",
                    F.when(total > 0, F.col("clones") / total).alias("clone_ratio"))


def _rows(df: DataFrame, cols: Sequence[str] | None, by: Sequence[str], *aggs):
    """One row per distinct (by, row), and the columns that tell it.

    Without ``cols`` a row is all its cells: the nine of the layout, and of a
    row of another width (blank ones, where ``read_rows`` keeps them) the whole text's.
    Its text (the least one, should quoting differ) comes along.
    """
    if cols is not None or CORRUPT not in df.columns:
        cols = list(PAIR_COLS if cols is None else cols)
        return df.groupBy(*by, *cols).agg(*aggs), cols
    keyed = df.withColumn("_cells", csv_cells(CORRUPT))
    return keyed.groupBy(*by, *PAIR_COLS, "_cells").agg(F.min(CORRUPT).alias(CORRUPT), *aggs), [*PAIR_COLS, CORRUPT]


def detect_duplicates(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct rows that occur more than once, with their number of copies (A1)."""
    rows, cols = _rows(df, cols, by, F.count(F.lit(1)).alias("copies"))
    return rows.filter(F.col("copies") > 1).select(*by, *cols, "copies")


def duplicate_report(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ("src",)) -> DataFrame:
    """Number of distinct duplicated rows per input (the figure the reference prints)."""
    return (detect_duplicates(df, cols, by).groupBy(*by)
            .agg(F.count(F.lit(1)).alias("duplicate_rows"),
                 F.sum(F.col("copies") - 1).alias("surplus_copies")))


def dedup_keep_first(df: DataFrame, cols: Sequence[str] | None = None, pos: str = "row_pos",
                     by: Sequence[str] = ()) -> DataFrame:
    """Drop repeated rows, keeping the first occurrence (A2).

    The copies are identical, so keeping the first only decides which
    position survives: ``min(row_pos)``, a partial + final aggregation with
    no window and no per-group list.
    """
    rows, cols = _rows(df, cols, by, F.min(pos).alias(pos))
    return rows.select(pos, *by, *cols)


def dedup_report(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ("src",)) -> DataFrame:
    """Kept and removed row counts per input (A3)."""
    per_row, _ = _rows(df, cols, by, F.count(F.lit(1)).alias("_n"))
    return per_row.groupBy(*by).agg(F.count(F.lit(1)).alias("kept"),
                                    (F.sum("_n") - F.count(F.lit(1))).alias("removed"))
