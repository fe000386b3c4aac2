"""Skew: one function in a third of all pairs, one class with most rows.
The bucketed ranks must give exactly what plain (one-task) windows give."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.operators import identity, quality, rank, split
from pairwright.schema import FUNC_COLS, PAIR_COLS
from pairwright.sources import fixtures as fx


def hot_pairs(spark, sf):
    lp = fx.spark_line_pairs(spark, sf)
    hot = F.col("row_pos") % 3 == 0
    return (lp.withColumn("folder1", F.when(hot, F.lit("hot")).otherwise(F.col("folder1")))
            .withColumn("file1", F.when(hot, F.lit("H")).otherwise(F.col("file1")))
            .withColumn("begin1", F.when(hot, F.lit("0")).otherwise(F.col("begin1")))
            .withColumn("end1", F.when(hot, F.lit("9")).otherwise(F.col("end1"))))


def brute_split(pairs, train=0.8, val=0.1, seed=0):
    valid = quality.class_rows(pairs).select("row_pos", *PAIR_COLS)
    u = identity.function_universe(valid).withColumn("_h", rank.seeded_hash(seed, *FUNC_COLS))
    n = u.count()
    a = u.withColumn("rank", F.row_number().over(Window.orderBy("_h", *FUNC_COLS)))
    a = a.withColumn("split", F.when(F.col("rank") <= int(train * n), "train")
                     .when(F.col("rank") <= int(train * n) + int(val * n), "val").otherwise("test"))
    t = split.in_split_pairs(valid, a.select(*FUNC_COLS, "rank", "split"))
    r = t.withColumn("rn", F.row_number().over(Window.partitionBy("split", "label").orderBy(F.col("row_pos").desc())))
    m = t.groupBy("split").agg(F.least(F.count_if(F.col("label") == "1"), F.count_if(F.col("label") == "0")).alias("m"))
    return (r.join(m, "split").filter("rn <= m")
            .select("split", (2 * (F.col("rn") - 1) + (F.col("label") == "0").cast("long")).alias("out_pos"),
                    "row_pos", *PAIR_COLS))


def test_split_exact_under_hot_function(spark, sf):
    p = hot_pairs(spark, sf)
    got = split.split_pairs(p)
    want = brute_split(p)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_position_rank_exact_with_one_big_class(spark, sf):
    lp = fx.spark_line_pairs(spark, sf).withColumn("g", F.when(F.col("row_pos") % 10 == 0, "small").otherwise("big"))
    a = rank.position_row_number(lp, "row_pos", partition_by=["g"], out="r", descending=True, width=64)
    b = lp.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy(F.col("row_pos").desc())))
    assert a.join(b, ["row_pos"]).filter("r != r2").count() == 0


def test_dedup_hot_copies(spark, sf):
    lp = fx.spark_line_pairs(spark, sf)
    hot = lp.withColumn("file1", F.when(F.col("row_pos") % 3 == 0, F.lit("H")).otherwise(F.col("file1")))
    hot = hot.withColumn("file2", F.when(F.col("row_pos") % 3 == 0, F.lit("H")).otherwise(F.col("file2")))
    got = quality.dedup_keep_first(hot)
    want = hot.groupBy(*PAIR_COLS).agg(F.min("row_pos").alias("row_pos"))
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert got.count() == want.count()


def test_range_partitions_grow_with_the_rows(spark, monkeypatch):
    """A global order's partitions hold a bounded number of rows, whatever the session's shuffle partitions are."""
    parts = []
    monkeypatch.setattr(rank, "RANGE_ROWS", 10, raising=False)
    monkeypatch.setattr(rank, "stage", lambda df, label: parts.append(df.rdd.getNumPartitions()) or df.localCheckpoint())
    df = spark.range(400).selectExpr("id", "(id * 7) % 400 AS k")
    got = rank.global_row_number(df, ["k"])
    assert parts[0] >= 40 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.filter("rn <> k + 1").count() == 0 and got.count() == 400


def test_semi_join_takes_repeated_members(spark):
    cells = [("p", "a", "1", "2", "q", "b", "3", "4", "1"), ("p", "a", "1", "2", "q", "c", "3", "4", "1")]
    pairs = spark.createDataFrame(cells, ", ".join(f"{c} string" for c in PAIR_COLS))
    members = spark.createDataFrame([("p", "a", "1", "2"), ("p", "a", "1", "2"), ("q", "b", "3", "4")], ", ".join(f"`{c}` string" for c in FUNC_COLS))
    got = split.semi_in_set(pairs, members)
    assert [tuple(r[c] for c in PAIR_COLS) for r in got.collect()] == cells[:1]
