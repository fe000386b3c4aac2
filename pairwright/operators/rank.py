"""Seeded order and exact ranks.

Splitting and re-balancing need an *exact* position of every row in a seeded
random order, and interleaving needs positions counted from the end of each
class.  A plain ``row_number() OVER (ORDER BY ...)`` runs in one task, and a
window per class is no better (two classes = two tasks).  Both ranks here are
computed in two passes instead, like ``zipWithIndex``:

* ``bucketed_row_number``: the caller gives a bucket that is monotone in the
  order (a prefix of a hash, or ``row_pos`` divided by a width).  Bucket sizes
  form a small table; a running sum over it gives each bucket's offset, and
  ``row_number`` runs per (group, bucket).  The join to the offsets and the
  window share the same keys, so the large side is shuffled once.  With a
  hash of distinct rows, or dense positions, every bucket has about the same
  size, whatever the group sizes are.
* ``global_row_number``: for an arbitrary composite order.  Spark range
  partitions on the whole (unique) key, so a hot leading value is still split
  evenly; per-partition counts (one row per partition, an explicit and hence
  bounded number) give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.session import shuffle_partitions, stage

# Rows that one partition of a global order sorts (some 200 bytes each in memory).
RANGE_ROWS = 1 << 20


def seeded_hash(seed, *cols) -> Column:
    """md5 hex of ``seed|c1|c2|...``: the seeded shuffle order (K1).

    DuckDB's ``md5(concat_ws('|', ...))`` gives the same string, which makes
    the order checkable against SQL.
    """
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def default_digits(spark) -> int:
    """Hash-prefix length for bucketed ranks: about 64 buckets per shuffle
    partition, 3 to 6 hex digits, so rows per bucket stay bounded as a
    cluster's partition count is scaled with its data, while the bucket-size
    table (whose running offsets are one small window) stays within 16^6 rows."""
    import math
    n = max(1, shuffle_partitions(spark)) * 64
    return min(6, max(3, math.ceil(math.log(n, 16))))


def hash_bucket(h: Column | str, digits: int = 3) -> Column:
    """Integer value of the first ``digits`` hex digits: 16**digits buckets."""
    h = F.col(h) if isinstance(h, str) else h
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def bucketed_row_number(df: DataFrame, order: Sequence[Column | str], bucket: Column,
                        partition_by: Sequence[str] = (), out: str = "rn",
                        total: str | None = None) -> DataFrame:
    """Exact 1-based ``row_number() OVER (PARTITION BY partition_by ORDER BY order)``.

    ``bucket`` must be non-decreasing along ``order`` inside each partition.
    ``total`` names an optional output column with the partition's row count,
    taken from the bucket-size table (no extra pass over ``df``).

    Rows whose partition columns are null are a group like any other: join and
    window share key columns that are never null (so the shuffle is shared, too).
    """
    groups = [f"_key{i}" for i in range(len(partition_by))]
    df = df.withColumns({"_bkt": bucket, **{g: never_null(c) for g, c in zip(groups, partition_by)}})
    keys = [*groups, "_bkt"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bn"))
    group = Window.partitionBy(*groups)
    before = group.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_bn").over(group).alias(total)] if total else []
    offsets = sizes.select(*keys, F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_boff"), *extra)
    within = Window.partitionBy(*keys).orderBy(*order)
    return (df.join(offsets, keys)
            .withColumn(out, F.row_number().over(within) + F.col("_boff"))
            .drop(*keys, "_boff"))


def never_null(c: str) -> Column:
    """The column as a string, null as a text that no value has: a key that joins null to null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def hash_row_number(df: DataFrame, h: str, tie: Sequence[str], partition_by: Sequence[str] = (),
                    out: str = "rn", digits: int | None = None, total: str | None = None) -> DataFrame:
    """Exact rank by hash column ``h`` (ties broken by ``tie``), bucketed on its prefix
    (``digits`` hex digits; default from the session's shuffle partitions)."""
    digits = digits or default_digits(df.sparkSession)
    return bucketed_row_number(df, [F.col(h), *[F.col(c) for c in tie]], hash_bucket(h, digits),
                               partition_by, out, total)


def position_row_number(df: DataFrame, pos: str = "row_pos", partition_by: Sequence[str] = (),
                        out: str = "rn", descending: bool = False, width: int = 1 << 16) -> DataFrame:
    """Exact rank by a unique position column, bucketed on ``pos // width``.

    Positions are unique, so no bucket holds more than ``width`` rows.
    """
    b = F.floor(F.col(pos) / F.lit(width)).cast("long")
    order = [F.col(pos).desc()] if descending else [F.col(pos).asc()]
    return bucketed_row_number(df, order, -b if descending else b, partition_by, out)


def positions_across(df: DataFrame, src: str = "src", pos: str = "row_pos") -> DataFrame:
    """Turns positions within each file into positions over all files, files in the order of ``src``.

    A file's offset is the sum of (last position + 1) over the files before
    it, so positions are unique again (gaps stay).  The offset table has one
    row per file and is broadcast: with few files, a join that shuffles by
    file would give each task a whole file's rows.
    """
    ends = df.groupBy(src).agg((F.max(pos) + 1).alias("_len"))
    before = Window.orderBy(src).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(F.col(src).alias("_src"), F.coalesce(F.sum("_len").over(before), F.lit(0)).alias("_off"))
    return (df.join(F.broadcast(offsets), F.col(src).eqNullSafe(F.col("_src")))
            .withColumn(pos, F.col(pos) + F.col("_off")).drop("_src", "_off"))


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number over a composite order without a one-task window.

    ``order`` should be unique per row (it is the tie-break as well).  The
    range exchange has an explicit partition count, so adaptive execution
    does not coalesce it: the session's, or more where a partition would
    otherwise hold over ``RANGE_ROWS`` rows and its sort spill.  The numbered rows are written once (``stage``):
    the range sampler is seeded per RDD, so two separately planned passes
    could cut different ranges; both passes read the one written table.
    """
    n = num_partitions or max(shuffle_partitions(df.sparkSession), -(-df.count() // RANGE_ROWS))
    s = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_p", F.spark_partition_id())
              .withColumn("_i", F.monotonically_increasing_id()), "numbered")
    sizes = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_pn"), F.min("_i").alias("_i0"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", "_i0", F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_poff"))
    # offsets has one row per range partition: at most n rows, a few hundred for 10^8 rows.
    return (s.join(F.broadcast(offsets), "_p")
            .withColumn(out, F.col("_i") - F.col("_i0") + F.col("_poff") + 1)
            .drop("_p", "_i", "_i0", "_poff"))
