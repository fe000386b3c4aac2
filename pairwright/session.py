"""Spark session defaults for pair jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pairwright", extra: dict | None = None) -> SparkSession:
    """Get or create a session with AQE on and the UI off.

    ``master`` and ``shuffle_partitions`` are only set when given, so a
    cluster's own settings win when the job is submitted there.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session names none (local tests) a private folder is made
    once per application and registered with ``setCheckpointDir`` (the
    setting itself is static and cannot be changed on a running session); on
    a cluster the setting must point at shared storage.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    sc = spark.sparkContext
    master = spark.conf.get("spark.master", None) or "local"
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _PRIVATE_DIRS:
        existing = sc.getCheckpointDir()
        if existing:
            _PRIVATE_DIRS[app] = existing
        else:
            d = tempfile.mkdtemp(prefix="pairwright-ckpt-")
            sc.setCheckpointDir(d)
            _PRIVATE_DIRS[app] = d
    return _PRIVATE_DIRS[app]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def stage(df, label: str = "stage"):
    """Write ``df`` once as parquet under the checkpoint folder and read it back.

    Used where one intermediate feeds several branches (an assignment table
    joined twice, a token table scanned by many windows): the work runs
    once, lineage is cut, and the read-back plan carries real file sizes for
    adaptive join planning.  The folder is the shared one the session names
    in ``spark.checkpoint.dir``, so the table outlives a lost executor.
    """
    import uuid

    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def app_id(spark: SparkSession) -> str:
    """The application id (read from the session conf, so it needs no SparkContext)."""
    return spark.conf.get("spark.app.id")


def staging_root(spark: SparkSession) -> str:
    """``<checkpoint dir>/pairwright/<application id>``: one folder per application."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pairwright/{app_id(spark)}"


def release_staged(spark: SparkSession) -> bool:
    """Delete this application's staged tables (call once results are written:
    DataFrames built before still read them lazily)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(path, True))
