"""Invariants and boundary cases of the pair operators."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.operators import identity, metrics, quality, rank, split
from pairwright.schema import FUNC_COLS, LEFT, PAIR_COLS, RIGHT
from pairwright.sources import fixtures as fx


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_splits_share_no_function(spark, sf):
    out = split.split_pairs(fx.spark_line_pairs(spark, sf))
    f = identity.function_ids(out, keep=["split"]).select("split", *FUNC_COLS).distinct()
    assert f.groupBy(*FUNC_COLS).count().filter("count > 1").count() == 0
    sizes = {(r.split, r.label): r["count"] for r in out.groupBy("split", "label").count().collect()}
    for s in ("train", "val", "test"):
        assert sizes.get((s, "1"), 0) == sizes.get((s, "0"), 0)


def test_out_pos_alternates(spark, sf):
    out = split.split_pairs(fx.spark_line_pairs(spark, sf))
    bad = out.filter(((F.col("out_pos") % 2 == 0) & (F.col("label") != "1"))
                     | ((F.col("out_pos") % 2 == 1) & (F.col("label") != "0")))
    assert bad.count() == 0


@pytest.mark.parametrize("parts", [1, 4, 200])
def test_same_result_any_partitioning(spark, sf, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    base = _rows(split.split_pairs(fx.spark_line_pairs(spark, sf)))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert _rows(split.split_pairs(fx.spark_line_pairs(spark, sf))) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_bucketed_rank_equals_window(spark, sf):
    u = identity.function_universe(fx.spark_line_pairs(spark, sf)).withColumn(
        "_h", rank.seeded_hash(7, *FUNC_COLS))
    a = rank.hash_row_number(u, "_h", FUNC_COLS, out="r", digits=2)
    b = u.withColumn("r2", F.row_number().over(Window.orderBy("_h", *FUNC_COLS)))
    assert a.join(b, [*FUNC_COLS, "_h"]).filter("r != r2").count() == 0


def test_global_rank_skewed_leading_key(spark, sf):
    lp = fx.spark_line_pairs(spark, sf).withColumn("hot", F.lit("x"))
    a = rank.global_row_number(lp, ["hot", "label", "row_pos"], out="r", num_partitions=5)
    b = lp.withColumn("r2", F.row_number().over(Window.orderBy("hot", "label", "row_pos")))
    assert a.join(b, ["row_pos"]).filter("r != r2").count() == 0


def test_rebalance_exact_and_k_zero(spark, sf):
    lp = fx.spark_line_pairs(spark, sf)
    out = split.rebalance(lp)
    c = {(r.src, r.label): r["count"] for r in out.groupBy("src", "label").count().collect()}
    for s in {k[0] for k in c}:
        assert c[(s, "1")] == c[(s, "0")]
    only_ones = lp.filter("label = '1'")
    assert split.rebalance(only_ones).count() == 0


def test_dedup_idempotent(spark, sf):
    lp = fx.spark_line_pairs(spark, sf)
    once = quality.dedup_keep_first(lp)
    assert _rows(quality.dedup_keep_first(once)) == _rows(once)
    assert quality.detect_duplicates(once).count() == 0


def test_split_fractions_odd(spark):
    u = spark.createDataFrame([(f"f{i}", "x", "0", "1") for i in range(100)], "folder string, file string, begin string, `end` string")
    a = split.assign_functions(u, 0.29, 0.7, seed=3)
    c = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert c == {"train": int(0.29 * 100), "val": int(0.7 * 100), "test": 100 - int(0.29 * 100) - int(0.7 * 100)}
    over = {r.split: r["count"] for r in split.assign_functions(u, 0.6, 0.6).groupBy("split").count().collect()}
    assert over.get("test", 0) == 0 and over["train"] == 60 and over["val"] == 40


def test_overlap_after_split_is_zero(spark, sf):
    out = split.split_pairs(fx.spark_line_pairs(spark, sf))
    tr = identity.function_ids(out.filter("split = 'train'"))
    te = identity.function_ids(out.filter("split = 'test'"))
    # identity A (with folder): the split's guarantee.  Identity B ignores the
    # folder, so part "5" and supplier "5" may coincide there by design.
    assert tr.intersect(te).count() == 0


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted int")
    r = metrics.binary_metrics(df).first()
    assert (r.accuracy, r.f1, r.precision, r.recall) == (1.0, 0.0, 0.0, 0.0)


def test_metrics_reject_other_labels(spark):
    df = spark.createDataFrame([(2, 0)], "label int, predicted int")
    with pytest.raises(Exception):
        metrics.binary_metrics(df).collect()


def test_class_predicate(spark):
    df = spark.createDataFrame([("1",), ("0",), (" 1",), ("2",)], "label string").withColumn("src", F.lit("a"))
    r = quality.class_balance(df).first()
    assert (r.total, r.clones, r.non_clones) == (2, 1, 1)


def test_in_split_keeps_only_same_split(spark, sf):
    lp = quality.class_rows(fx.spark_line_pairs(spark, sf))
    a = split.assign_functions(identity.function_universe(lp), 0.8, 0.1)
    t = split.in_split_pairs(lp, a)
    chk = (t.join(a.select(*[F.col(f).alias(c) for f, c in zip(FUNC_COLS, LEFT)], F.col("split").alias("s1")), list(LEFT))
           .join(a.select(*[F.col(f).alias(c) for f, c in zip(FUNC_COLS, RIGHT)], F.col("split").alias("s2")), list(RIGHT)))
    assert chk.filter("s1 != split or s2 != split").count() == 0
    assert set(PAIR_COLS) <= set(t.columns)
