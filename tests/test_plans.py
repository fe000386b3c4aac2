"""Plan shape checks over the whole catalogue: no cross products or nested-loop
joins anywhere, map-side partial aggregation, and pruned scans."""

import pytest

from pyspark.sql.readwriter import DataFrameWriter

from pairwright.functions.text import normalize_no_rename
from pairwright.plans.catalog import QUERIES


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, sf, name, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def noted(self, *args, **kwargs):  # what a query stages on its way
        plans.append(plan_of(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    plans.append(plan_of(QUERIES[name](spark, sf)))
    for plan in plans:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_dedup_combines_map_side(spark, sf):
    assert "partial_min" in plan_of(QUERIES["dedup_keep_first"](spark, sf))


def test_scans_are_pruned(spark, sf):
    plan = plan_of(QUERIES["binary_metrics"](spark, sf))
    assert "text" not in plan.split("ReadSchema")[-1] and "quality" in plan


def test_each_text_rule_is_evaluated_once(spark, sf):
    df = spark.createDataFrame([("a",)], "code string")
    plan = df.select(normalize_no_rename("code").alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 5 + 3 + 5  # white space, three rules, white space
    assert plan.count("regexp_extract_all(") == 1


def test_balance_is_one_partial_aggregation(spark, sf):
    plan = plan_of(QUERIES["class_balance_lines"](spark, sf))
    assert "partial_count" in plan
