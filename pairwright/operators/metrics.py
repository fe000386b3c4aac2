"""Classification metrics and best-record selection.

One aggregation computes the confusion counts; the ratios are guarded the
way the reference's metric library guards them (zero division -> 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "f1", "precision", "recall")


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "predicted",
              by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and n per group; a label or prediction outside {0, 1} raises."""
    l, p = F.col(label), F.col(pred)
    g = df.groupBy(*by).agg(
        F.count_if((l == 1) & (p == 1)).alias("tp"), F.count_if((l == 0) & (p == 1)).alias("fp"),
        F.count_if((l == 1) & (p == 0)).alias("fn"), F.count_if((l == 0) & (p == 0)).alias("tn"),
        F.count(F.lit(1)).alias("n"))
    bad = F.col("n") - F.col("tp") - F.col("fp") - F.col("fn") - F.col("tn")
    return g.withColumn("n", F.when(bad > 0, F.raise_error(F.lit("labels and predictions must be 0 or 1")))
                        .otherwise(F.col("n")).cast("long"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "predicted",
                   by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, F1, precision, recall; positive class 1; zero division -> 0."""
    c = confusion(df, label, pred, by)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select(*by,
                    _ratio(tp + tn, n).alias("accuracy"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    _ratio(tp, tp + fp).alias("precision"),
                    _ratio(tp, tp + fn).alias("recall"))


def predicted_counts(df: DataFrame, label: str = "label", pred: str = "predicted",
                     by: Sequence[str] = ()) -> DataFrame:
    """Correct / total = accuracy, and how often each class was predicted."""
    l, p = F.col(label), F.col(pred)
    g = df.groupBy(*by).agg(F.count_if(l == p).alias("correct"), F.count(F.lit(1)).alias("total"),
                            F.count_if(p == 1).alias("predicted_positive"),
                            F.count_if(p == 0).alias("predicted_negative"))
    return g.withColumn("accuracy", F.col("correct") / F.col("total"))


def metric_report(metrics: DataFrame, prefix: str | Column = "test", by: Sequence[str] = ()) -> DataFrame:
    """Long (metric, value) rows named ``<prefix>_<metric>``, ordered by group and name.

    A column as ``prefix`` (such as the split) names each group's rows by its own value.
    """
    cols = [c for c in metrics.columns if c not in by]
    long = metrics.unpivot(list(by), cols, "metric", "value")
    named = F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("_"), F.col("metric"))
    return long.withColumn("metric", named).orderBy(*by, "metric")


def best_record(log: DataFrame, greater_is_better: bool = True, step: str = "step",
                metric: str = "metric", value: str = "value") -> DataFrame:
    """A10: per metric, the record with the best value; ties -> earliest step."""
    if greater_is_better:
        best = F.max(F.struct(F.col(value).alias("v"), (-F.col(step)).alias("s")))
        step_out = -F.col("_b.s")
    else:
        best = F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s")))
        step_out = F.col("_b.s")
    return (log.filter(F.col(value).isNotNull()).groupBy(metric).agg(best.alias("_b"))
            .select(metric, step_out.alias("best_step"), F.col("_b.v").alias("best_value")))
