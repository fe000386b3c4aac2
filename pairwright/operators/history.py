"""Run-history tables: metric log -> plotted series.

A log record may carry any subset of metric keys.  A series is the values of
one key in record order with the record *index* as x; the reference draws
some series (eval loss, F1, precision, recall) against the indexes of another
key's records (eval accuracy), pairing the k-th value with the k-th index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.rank import position_row_number, positions_across
from pairwright.sources.csv_pairs import csv_row_positions

# fixed values: the reference's metric selection and its x-axis sources
REFERENCE_SELECTION = ("loss", "eval_loss", "eval_accuracy", "eval_f1", "eval_precision",
                       "eval_recall", "learning_rate")
REFERENCE_X_OF = {"eval_loss": "eval_accuracy", "eval_f1": "eval_accuracy",
                  "eval_precision": "eval_accuracy", "eval_recall": "eval_accuracy"}


def long_log(records: DataFrame, step: str = "step") -> DataFrame:
    """Wide records (one column per key, NULL = key absent) -> (step, metric, value)."""
    keys = [c for c in records.columns if c != step]
    return (records.unpivot([step], keys, "metric", "value")
            .filter(F.col("value").isNotNull()))


def parse_records(lines: DataFrame, line: str = "line", step: str = "step") -> DataFrame:
    """JSON records of any keys -> (step, metric, value); values that are no numbers give no row.

    A record is one object of whatever keys it has (a map, so no schema is
    inferred and no record must look like another).
    """
    record = F.from_json(F.col(line), "map<string,string>")
    return (lines.select(step, F.explode(record).alias("metric", "_v"))
            .select(step, "metric", F.col("_v").try_cast("double").alias("value")).filter("value is not null"))


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """M1: log files of one JSON record a line -> (step, metric, value).

    ``step`` is the record's index over all files, in the order of their paths;
    blank lines are no records.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select(F.col("value").alias("line"), "_metadata")
    placed = positions_across(csv_row_positions(lines.filter(F.trim("line") != "")))
    return parse_records(placed.withColumnRenamed("row_pos", "step"))


def read_trainer_state(spark: SparkSession, path: str, field: str = "log_history") -> DataFrame:
    """M1: one JSON document whose ``field`` is the list of records -> (step, metric, value)."""
    state = spark.read.option("multiLine", True).schema(f"`{field}` array<map<string,string>>").json(path)
    records = state.select(F.posexplode(field).alias("_i", "_r")).select(F.col("_i").cast("long").alias("step"), F.explode("_r").alias("metric", "_v"))
    return records.select("step", "metric", F.col("_v").try_cast("double").alias("value")).filter("value is not null")


def metric_series(log: DataFrame, selection: Sequence[str] | None = None,
                  x_of: Mapping[str, str] | None = None, step: str = "step") -> DataFrame:
    """M1/M2: (metric, k, x, y) for the selected metrics; empty series are absent.

    ``k`` is the 1-based occurrence number of the metric, ``y`` its value,
    ``x`` the record index of the k-th record holding ``x_of[metric]`` (the
    metric itself by default).  Occurrence numbers are exact ranks by
    record index per metric, bucketed so one frequent metric is not one task.
    """
    x_of = dict(x_of or {})
    present = log.filter(F.col("value").isNotNull())
    wanted = set(selection or []) | set(x_of.values())
    if selection is not None:
        present = present.filter(F.col("metric").isin(*sorted(wanted)))
    ranked = position_row_number(present, step, partition_by=["metric"], out="k")
    xs = ranked.select(F.col("metric").alias("x_metric"), "k", F.col(step).alias("x"))
    src = F.col("metric")
    for m, xm in x_of.items():
        src = F.when(F.col("metric") == m, F.lit(xm)).otherwise(src)
    ys = ranked.withColumn("x_metric", src)
    if selection is not None:
        ys = ys.filter(F.col("metric").isin(*selection))
    return ys.join(xs, ["x_metric", "k"]).select("metric", "k", "x", F.col("value").alias("y"))
