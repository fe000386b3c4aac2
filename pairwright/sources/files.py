"""Code files as a table.

``read_code_files`` lists a folder tree with Spark's ``binaryFile`` source:
one row per file, bytes decoded as UTF-8 with invalid sequences dropped and
line ends normalised (as Python's text mode with ``errors="ignore"`` does).
A file that a pair names but that does not exist simply has no row; the
fetch join then yields an empty snippet.

``read_named_files`` opens only the files that are asked for: it lists the tree
without content (the source then opens no file), keeps the listed files that
are named, and reads those, a bounded number of paths at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.lines import decode_utf8_lenient, universal_newlines
from pairwright.operators.rank import global_row_number
from pairwright.session import stage, staging_root

#: Scheme and host of a qualified path (file:, hdfs://host:port, s3a://bucket).
_STORE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?)?"


def read_code_files(spark: SparkSession, root: str, glob: str = "*", base: str | None = None) -> DataFrame:
    """(path, text) for every file under ``root``; ``path`` is relative to ``base`` (default ``root``)."""
    return _tree(spark, root, glob).select(_relative(base or root).alias("path"), _text())


def _text():
    return universal_newlines(decode_utf8_lenient(F.col("content"))).alias("text")


def _plain(path: str) -> str:
    """The path with its glob characters taken as they are."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_one(spark: SparkSession, path: str) -> DataFrame:
    """(text) of one file, one row; a missing file raises."""
    return spark.read.format("binaryFile").load(_plain(path)).select(_text())


def _tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(root))


def _relative(base: str):
    return F.regexp_replace(F.col("path"), _STORE + "/*" + re.escape(re.sub(_STORE, "", base.rstrip("/")).lstrip("/")) + "/", "")


def read_named_files(spark: SparkSession, root: str, needed: DataFrame, glob: str = "*", base: str | None = None,
                     batch: int = 10_000) -> DataFrame:
    """(path, text) of the files under ``root`` whose path is in ``needed`` (column ``path``, relative to ``base``).

    Phase 1 lists paths only and semi-joins them; phase 2 reads the named files,
    ``batch`` paths a job, into one staged table.  The driver holds one batch of paths, never all.
    """
    rel = _relative(base or root)
    listed = _tree(spark, root, glob).select(F.col("path").alias("file"), rel.alias("path"))
    wanted = global_row_number(listed.join(needed.select("path").distinct(), "path", "left_semi"), ["file"], "n")
    wanted = stage(wanted.withColumn("batch", F.floor((F.col("n") - 1) / batch)), "named-files")
    at = f"{staging_root(spark)}/file-contents-{uuid.uuid4().hex}"
    spark.createDataFrame([], "path string, text string").write.parquet(at)
    for i in range((wanted.agg(F.max("batch")).first()[0] or 0) + 1):
        files = [_plain(r["file"]) for r in wanted.filter(F.col("batch") == i).select("file").collect()]  # at most ``batch``
        if files:
            spark.read.format("binaryFile").load(files).select(rel.alias("path"), _text()).write.mode("append").parquet(at)
    return spark.read.parquet(at)


def derived_path(path: str, suffix: str, out_dir: str | None = None) -> str:
    """``<stem><suffix>`` next to the input, or inside ``out_dir``."""
    import os
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0] + suffix
    return os.path.join(out_dir or os.path.dirname(path.rstrip("/")), stem)
