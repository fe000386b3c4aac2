"""Packing: optimal length buckets, then token-budget batches inside each.

The global length histogram (one row per distinct length; D distinct lengths
need some D*D/2 words of text, so it stays small) goes to the driver, where
dynamic programming over the exact lengths chooses the ``buckets`` upper
bounds with the least total padding.  A bucket's batch holds
``budget // bound`` sequences (at least one), so its padded size keeps to the
token budget unless a single sequence is longer.  Sequences are numbered
inside their bucket by a range-partitioned rank, so no bucket is one task.

A sequence's length is its number of words plus one end token, so a null or
empty text has length 1.  Ties in the order (bucket, doc_id, hash of the text)
are identical rows, which are interchangeable; null doc_ids come first; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import staged as stage
from pairwright.llm.common import from_text, keyed
from pairwright.operators.rank import global_row_number

BUCKETS, BUDGET = 16, 16_384


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds (ascending, the last is the longest length) with the least padding.

    ``lengths`` ascending and distinct.  Divide and conquer over the split
    points: the cost of a bucket obeys the quadrangle inequality.
    """
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = lengths.astype(np.float64) * c[1:]  # one bucket over the first j+1 lengths, less the sum of lengths
    best = np.concatenate([[0.0], best])
    back = []
    for _ in range(1, min(buckets, n)):
        cur, arg = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (c[j] - c[i])
            k = int(np.argmin(cost))
            cur[j], arg[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, arg[j]), (j + 1, hi, arg[j], b)]
        back.append(arg)
        best = cur
    out, j = [], n
    for arg in reversed(back):
        out.append(int(lengths[j - 1]))
        j = int(arg[j])
        if j == 0:
            break
    else:
        out.append(int(lengths[j - 1]))
    return sorted(set(out))


def lengths_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, length (words and the end token)."""
    def make():
        return lambda batch: [[len(t.encode("utf-8").split()) + 1 for t in batch]]
    return from_text(keyed(docs, id_col, text_col), make, {"length": "long"})


def pack(sized: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, length, bucket, bucket_len, batch (from 0 in the bucket), slot, pad.

    ``sized``: doc_id, h, length.
    """
    sized = stage(sized.select("doc_id", "h", "length"), "packing-lengths")

    hist = sorted((r["length"], r["n"]) for r in sized.groupBy("length")
                  .agg(F.count(F.lit(1)).alias("n")).collect())  # one row per distinct length
    ls = np.array([x[0] for x in hist], dtype=np.int64)
    ns = np.array([x[1] for x in hist], dtype=np.int64)
    ups = bounds(ls, ns, buckets) or [1]
    sizes = [int(ns[(ls > a) & (ls <= b)].sum()) for a, b in zip([0, *ups], ups, strict=False)]
    before = [0, *np.cumsum(sizes).tolist()]
    bucket = F.lit(len(ups) - 1)
    for i in range(len(ups) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ups[i], i).otherwise(bucket)

    def at(values):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1).cast("long")

    placed = global_row_number(sized.withColumn("bucket", bucket.cast("int")), ["bucket", "doc_id", "h"], "rn")
    per = at([max(1, budget // u) for u in ups])
    pos = F.col("rn") - 1 - at(before[:-1])
    return placed.select("doc_id", "length", "bucket", at(ups).alias("bucket_len"), F.floor(pos / per).cast("long").alias("batch"),
                         (pos % per).cast("int").alias("slot"), (at(ups) - F.col("length")).alias("pad"))


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(lengths_of(docs, id_col, text_col), buckets, budget)
