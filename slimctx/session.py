"""Spark session defaults and the shared scratch location.

Everything that needs to write intermediate data (stream inputs, stream
checkpoints, lineage cuts) goes below ``spark.checkpoint.dir`` — the
shared folder a cluster names.  Without that setting a local master (tests,
a laptop) gets a folder of its own; on a cluster that is an error, since each
executor would write to its own disk.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on.  AQE re-plans joins at runtime: a side
# whose *measured* size is under the broadcast threshold is broadcast, hot
# partitions (hub files every entry reaches) are split by the skew-join
# rule, and small shuffle partitions are coalesced.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: (application, folder) of every intermediate table, for ``clean_scratch``.
_WRITTEN: list[tuple[str, str]] = []


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "slimctx", driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:   # local mode: the driver JVM is the only executor
        builder = builder.config("spark.driver.memory", driver_memory)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL settings on an existing session (driver-made ones too)."""
    for k, v in SESSION_DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on an already running session
            pass


def checkpoint_root(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` if the cluster sets
    one, else a fresh local folder (set once per session, as in tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="slimctx-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the checkpoint root for one job's output."""
    root = checkpoint_root(spark)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    return path


def materialize(df, name: str = "table"):
    """Cut lineage by writing the DataFrame as a parquet table below the
    shared checkpoint folder and reading it back.  One pass computes and
    writes it (an RDD checkpoint of an unpersisted plan would compute it
    twice); the files survive executor loss; the read-back is columnar, so
    later readers prune columns.  Never a local checkpoint."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"mat-{name}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clean_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this session wrote; returns how many.
    Results that still read them have to be written first."""
    paths = [p for app, p in _WRITTEN if app == spark.sparkContext.applicationId]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(p)
        hadoop_path.getFileSystem(conf).delete(hadoop_path, True)
    _WRITTEN[:] = [x for x in _WRITTEN if x[0] != spark.sparkContext.applicationId]
    return len(paths)
