"""Benchmark: run the headline queries over the whole tables at $BENCH_SF_DIR.

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed to completion with the ``noop`` sink (every row is
produced, nothing is collected on the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairwright.plans.catalog import QUERIES  # noqa: E402
from pairwright.session import get_spark, release_staged  # noqa: E402

HEADLINE = ["split_pairs", "function_partition", "rebalance", "interleave", "dedup_keep_first",
            "detect_duplicates", "class_balance_lines", "overlap_pairwise", "overlap_nway",
            "fetch_pairs", "normalize_pairs", "normalize_text", "rename_identifiers", "binary_metrics",
            "metric_series", "layout_strict_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=2 * cpus,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    # JVM / code-generation warm-up on generated rows (no benchmark data is read):
    # one aggregate, one join and one window, like the operators below use.
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    g = spark.range(200_000).select((F.col("id") % 997).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    (g.groupBy("k").count().join(g, "k").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h")))
     .write.format("noop").mode("overwrite").save())
    times: dict[str, float] = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        spark.catalog.clearCache()
    release_staged(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
