"""Class scores from logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: class names as printed by the reference
CLASS_NAMES = {1: "CLONE", 0: "NOT CLONE"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits) -> Column:
    """``exp(x - max) / sum`` over an array column."""
    # one-element arrays name a value, which is then computed once per row
    def exps(z: Column) -> Column:
        return F.transform(F.array(F.array_max(z)), lambda top: F.transform(z, lambda x: F.exp(x - top)))[0]

    def shares(e: Column) -> Column:
        total = F.array(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x))
        return F.transform(total, lambda t: F.transform(e, lambda x: x / t))[0]

    return F.transform(F.array(exps(_c(logits))), shares)[0]


def argmax(arr) -> Column:
    """0-based index of the largest element, first one on ties."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def confidence(probs) -> Column:
    """Probability of the arg-max class."""
    return F.array_max(_c(probs))


def class_name(pred) -> Column:
    """1 -> CLONE, anything else -> NOT CLONE."""
    return F.when(_c(pred) == 1, F.lit(CLASS_NAMES[1])).otherwise(F.lit(CLASS_NAMES[0]))
