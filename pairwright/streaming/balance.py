"""Class balance over pair files as they arrive (Structured Streaming).

The reference has no streaming code; its balance tool reads a list of files
and reports per file.  This is the same operator (``quality.class_balance``)
over a folder that receives pair files: each new file is read once, the
per-file counts are streaming state (one row per file), and the report is
emitted in complete mode.  No watermark is needed: state grows with the
number of files, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.quality import class_balance
from pairwright.sources.csv_pairs import CSV_OPTIONS, _schema


def balance_stream(spark: SparkSession, folder: str, header: bool = True,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming per-file class balance of the pair files in ``folder``."""
    r = (spark.readStream.schema(_schema(("folder1", "file1", "begin1", "end1", "folder2", "file2",
                                          "begin2", "end2", "label")))
         .option("header", header).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record").options(**CSV_OPTIONS))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = r.csv(folder).withColumn("src", F.col("_metadata.file_path"))
    return class_balance(stream)


def start_balance(spark: SparkSession, folder: str, checkpoint: str, query_name: str = "pair_balance",
                  header: bool = True):
    """Run the report into an in-memory table named ``query_name``."""
    return (balance_stream(spark, folder, header).writeStream.outputMode("complete")
            .format("memory").queryName(query_name).option("checkpointLocation", checkpoint).start())
