"""Spark session helpers.

Cluster settings (shuffle partitions, checkpoint directory, AQE) belong to the
deployment; ``get_session`` only fills in what is unset, so the same code runs
in tests on ``local[*]`` and on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings this library relies on; applied only where the session leaves them unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "medialake") -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # local mode: the driver is the only JVM
        b = b.config("spark.driver.memory", os.environ.get("MEDIALAKE_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set ``DEFAULTS`` except where the deployment configured a value."""
    explicit = spark.sparkContext.getConf()
    for k, v in DEFAULTS.items():
        if not explicit.contains(k):
            spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment must set it to shared storage: without it this
    raises, since executors do not see each other's local folders. Only in
    local mode, as in tests, an unset folder is replaced by a scratch one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not d and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="medialake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, grouped per Spark
    application (``<checkpoint dir>/medialake-<app id>/``) so the scratch of
    a finished application can be removed as one folder."""
    import uuid

    base = os.path.join(checkpoint_dir(spark), f"medialake-{spark.sparkContext.applicationId}")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def materialize(df):
    """Cut the lineage: write ``df`` as a Parquet table under the shared
    checkpoint folder and read it back.

    Used where a frame is read by several passes, so the upstream (conform, layout) runs once, a lost
    executor re-reads the table instead of recomputing it, and every pass
    still gets column pruning and filter pushdown (a checkpointed RDD would
    deserialize all columns on each scan)."""
    spark = df.sparkSession
    path = scratch_path(spark, "materialized")
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Codec of stored media tables.
CODEC = "zstd"
_PATHS = threading.local()  # a list of paths for each ``settled`` that is at work


@contextmanager
def settings(spark, values: dict):
    """The session's settings while a block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cleared(spark):
    """Shuffle files of the writes in a block go when each write ends; else they
    stay until the driver happens to collect its garbage. A write plans its
    frame anew, so nothing else reads them."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def stored(df):
    """:func:`materialize` for large tables of many passes: with little left on
    disk beside the table, which is compressed."""
    spark = df.sparkSession
    path = scratch_path(spark, "stored")
    for paths in getattr(_PATHS, "open", [])[-1:]:
        paths.append(path)
    with cleared(spark):
        df.write.parquet(path, compression=CODEC)
    return spark.read.parquet(path)


def settled(build):
    """The frame that ``build`` gives, stored; what ``build`` has stored on the
    way is deleted then. For steps whose tables nothing but that frame reads."""
    _PATHS.open = getattr(_PATHS, "open", [])
    _PATHS.open.append([])
    try:
        df = build()
    finally:
        own = _PATHS.open.pop()
    df = stored(df)
    spark = df.sparkSession
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in own:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    return df


def write_partitioned(df, path: str, column: str, writers: int = 8, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet in a folder per value of ``column``, which has at
    most ``writers`` values or so. A task keeps a file of each open; without
    that, Spark sorts all its rows by the column first, and spills them. With
    more values the sort comes back."""
    spark = df.sparkSession
    with cleared(spark), settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(writers)}):
        df.write.mode(mode).partitionBy(column).parquet(path, compression=CODEC)
