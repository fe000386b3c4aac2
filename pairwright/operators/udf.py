"""Pluggable normaliser and metric functions.

A normaliser is either a Column -> Column function (runs in the JVM, the
preferred form) or a plain Python ``str -> str`` function.  A Python one is
run in an Arrow-batched pandas UDF; a row on which it raises keeps its
original text (F2), as the reference's preprocessor does.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.metrics import binary_metrics


def column_normalizer(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """Wrap a Python ``str -> str`` normaliser as a Column function (F1, F2)."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None or t == "":
                out.append(t)
                continue
            try:
                out.append(fn(t))
            except Exception:  # noqa: BLE001 - per-row isolation is the point
                out.append(t)
        return pd.Series(out, dtype=object)

    return lambda c: run(c)


def normalizer(fn) -> Callable[[Column], Column]:
    """Accept either form; Column functions are returned unchanged."""
    return fn if getattr(fn, "column_function", False) else column_normalizer(fn)


def column_function(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Mark ``fn`` as a Column -> Column normaliser."""
    fn.column_function = True
    return fn


def evaluate(predictions: DataFrame, metric_fn=binary_metrics, pred: str = "predicted",
             label: str = "label") -> DataFrame:
    """any ``metric_fn(df, label, pred)`` over a prediction table."""
    return metric_fn(predictions, label, pred)
