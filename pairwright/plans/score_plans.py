"""Queries for metrics, scores and run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.functions import scores as S
from pairwright.operators import history, metrics
from pairwright.plans.registry import query
from pairwright.sources import fixtures as fx

CONF_SQL = """
SELECT count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp,
       count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn,
       count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn,
       count(*) AS n
FROM predictions"""

METRICS_SQL = f"""
SELECT CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0 END AS accuracy,
       CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall
FROM ({CONF_SQL})"""


@query("binary_metrics", fx.sql_with(METRICS_SQL, "predictions"))
def q_binary_metrics(spark, d):
    return metrics.binary_metrics(fx.spark_predictions(spark, d))


@query("metric_report", fx.sql_with(f"""
SELECT 'test_' || metric AS metric, value FROM (
  UNPIVOT ({METRICS_SQL}) ON accuracy, f1, precision, recall INTO NAME metric VALUE value)""",
                                    "predictions"))
def q_metric_report(spark, d):
    return metrics.metric_report(metrics.binary_metrics(fx.spark_predictions(spark, d)), "test")


@query("predicted_counts", fx.sql_with("""
SELECT count(*) FILTER (WHERE label = predicted) AS correct, count(*) AS total,
       count(*) FILTER (WHERE predicted = 1) AS predicted_positive,
       count(*) FILTER (WHERE predicted = 0) AS predicted_negative,
       count(*) FILTER (WHERE label = predicted) / count(*) AS accuracy
FROM predictions""", "predictions"))
def q_predicted_counts(spark, d):
    return metrics.predicted_counts(fx.spark_predictions(spark, d))


@query("softmax_argmax", fx.sql_with("""
SELECT vec_id, list_transform(probs, lambda p: round(p, 9)) AS probs,
       list_position(probs, list_max(probs)) - 1 AS predicted,
       round(list_max(probs), 9) AS confidence,
       CASE WHEN list_position(probs, list_max(probs)) - 1 = 1 THEN 'CLONE' ELSE 'NOT CLONE' END AS class_name
FROM (SELECT vec_id,
             list_transform(e, lambda x: x / list_sum(e)) AS probs
      FROM (SELECT vec_id, list_transform(logits, lambda y: exp(y - list_max(logits))) AS e FROM logits))""", "logits"))
def q_softmax_argmax(spark, d):
    # Probabilities are reported to 1e-9: exp() differs in the last bit between
    # engines, and a rounded value is the same double in both.
    p = fx.spark_logits(spark, d).select("vec_id", S.softmax("logits").alias("probs"))
    pred = S.argmax("probs")
    return p.select("vec_id", F.transform("probs", lambda x: F.round(x, 9)).alias("probs"),
                    pred.alias("predicted"), F.round(S.confidence("probs"), 9).alias("confidence"),
                    S.class_name(pred).alias("class_name"))


@query("best_record", fx.sql_with("""
SELECT metric, step AS best_step, value AS best_value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, step) AS r FROM metric_log
  WHERE value IS NOT NULL) WHERE r = 1""", "metric_log"))
def q_best_record(spark, d):
    return metrics.best_record(fx.spark_metric_log(spark, d))


# Our log's keys standing in for the reference's: view ~ eval accuracy, error and
# purchase are drawn against its record indexes, signup is not selected.
SELECTION = ("click", "error", "purchase", "view")
X_OF = {"error": "view", "purchase": "view"}


SERIES_SQL = fx.sql_with(f"""
WITH occ AS (SELECT metric, step, value, row_number() OVER (PARTITION BY metric ORDER BY step) AS k
             FROM metric_log WHERE value IS NOT NULL)
SELECT y.metric, y.k, x.step AS x, y.value AS y
FROM occ y JOIN occ x ON x.k = y.k AND x.metric = CASE {' '.join(f"WHEN y.metric = '{m}' THEN '{xm}'" for m, xm in X_OF.items())} ELSE y.metric END
WHERE y.metric IN ({', '.join(f"'{m}'" for m in SELECTION)})""", "metric_log")


@query("metric_series", SERIES_SQL)
def q_metric_series(spark, d):
    return history.metric_series(fx.spark_metric_log(spark, d), SELECTION, X_OF)


@query("metric_series_records", SERIES_SQL)
def q_metric_series_records(spark, d):
    # M1: the same series from one JSON record a step, each with keys of its own
    log = fx.spark_metric_log(spark, d)
    record = F.to_json(F.map_from_arrays(F.array("metric", F.concat("metric", F.lit("_note"))), F.array(F.col("value").cast("string"), F.lit("kept"))))
    lines = log.select("step", F.when(F.col("value").isNotNull(), record).otherwise(F.lit("{}")).alias("line"))
    return history.metric_series(history.parse_records(lines), SELECTION, X_OF)
