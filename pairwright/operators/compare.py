"""Features that set the two texts of a pair against each other.

* ``winnow``: fingerprints of a token list.  Every run of ``gram`` tokens is
  hashed (first 60 bits of md5, the same in any engine), and of every
  ``window`` neighbouring hashes the least is kept, so two texts that share
  ``gram + window - 1`` tokens in a row share a fingerprint, wherever it stands.
* ``fingerprint_features``: overlap and containment of both sides' fingerprints.
* ``bucket_features``: both sides' token counts in hashed buckets, weighted by
  inverse document frequency; their cosine and their difference by bucket.

Everything is a built-in expression per row; the only state is the vector of
bucket weights (``2**10`` numbers, whatever the data's size).
"""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, IDFModel, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BUCKETS = 5, 4, 1 << 10


def winnow(tokens: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Sorted distinct fingerprints; fewer tokens than ``gram``: the whole list is one run; none: no fingerprint."""
    def runs(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - gram, F.lit(0))), lambda i: F.conv(
            F.substring(F.md5(F.array_join(F.slice(t, i + 1, F.lit(gram)), " ")), 1, 15), 16, 10).cast("long"))

    def least(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - window, F.lit(0))), lambda i: F.array_min(F.slice(h, i + 1, F.lit(window))))

    def kept(t: Column) -> Column:
        # one-element arrays name the hashes, which are then made once
        return F.array_sort(F.array_distinct(F.transform(F.array(runs(t)), least)[0]))

    return F.when(F.size(tokens) > 0, kept(tokens)).otherwise(F.array().cast("array<bigint>"))


def fingerprint_features(df: DataFrame, t1: str = "tokens1", t2: str = "tokens2") -> DataFrame:
    """Adds prints1, prints2, prints_shared (a count), prints_jaccard and prints_held (shared by the smaller side's count); 0 without prints."""
    out = df.withColumn("prints1", winnow(F.col(t1))).withColumn("prints2", winnow(F.col(t2)))
    out = out.withColumn("prints_shared", F.size(F.array_intersect("prints1", "prints2")))
    n1, n2, both = F.size("prints1"), F.size("prints2"), F.col("prints_shared")
    return out.withColumn("prints_jaccard", F.when(n1 + n2 > 0, both / (n1 + n2 - both)).otherwise(F.lit(0.0))) \
        .withColumn("prints_held", F.when(F.least(n1, n2) > 0, both / F.least(n1, n2)).otherwise(F.lit(0.0)))


def _counts(col: str, out: str, buckets: int) -> HashingTF:
    return HashingTF(inputCol=col, outputCol=out, numFeatures=buckets)


def fit_weights(df: DataFrame, t1: str = "tokens1", t2: str = "tokens2", buckets: int = BUCKETS) -> IDFModel:
    """Inverse document frequency of every bucket over the texts of both sides."""
    texts = df.select(F.explode(F.array(F.col(t1), F.col(t2))).alias("tokens"))
    return IDF(inputCol="counts", outputCol="weighted").fit(_counts("tokens", "counts", buckets).transform(texts))


def bucket_features(df: DataFrame, weights: IDFModel, t1: str = "tokens1", t2: str = "tokens2") -> DataFrame:
    """Adds idf_cosine (0 if a side has no weight) and bucket_diff (vector: absolute difference by bucket)."""
    out = df
    for col, name in ((t1, "_w1"), (t2, "_w2")):
        out = _counts(col, "_counts", len(weights.idf)).transform(out)
        out = weights.copy({weights.inputCol: "_counts", weights.outputCol: name}).transform(out).drop("_counts")
    out = out.withColumns({"_w1": vector_to_array("_w1"), "_w2": vector_to_array("_w2")})

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    size = F.sqrt(dot("_w1", "_w1")) * F.sqrt(dot("_w2", "_w2"))
    out = out.withColumn("idf_cosine", F.when(size > 0, dot("_w1", "_w2") / size).otherwise(F.lit(0.0))) \
        .withColumn("bucket_diff", array_to_vector(F.zip_with("_w1", "_w2", lambda x, y: F.abs(x - y)))).drop("_w1", "_w2")
    # the vector's length is known, so no row need be looked at for it
    return VectorSizeHint(inputCol="bucket_diff", size=len(weights.idf), handleInvalid="optimistic").transform(out)
