"""Structured Streaming over the usage log.

The log is an append-only folder of JSON-lines files.  The streaming
queries keep the dashboard series up to date as new files arrive:

* ``totals`` / per-file / per-day / histogram are ``groupBy`` aggregates in
  ``update`` mode: a micro-batch hands on the keys it changed, nothing else.
  State is bounded by #files + #days + 10 buckets, so no watermark is needed
  (there is no event-time window).
* running total by day: non-time windows are not allowed on streams, so the
  window is applied when the series is read, on one row per day.

Each micro-batch writes the changed rows to a folder of its own, named by its
batch id, below the shared checkpoint folder.  Every ``FANOUT`` batches are
merged into one folder that holds the latest row of every key, every
``FANOUT`` of those into one of the next level, and so on: after n batches a
reader opens about FANOUT * log(n) folders.  Level and first batch id name a
folder, so a batch that is replayed after a failure replaces its own folder
and repeats its merges, and every result counts once.  What a merge replaced
stays until the next merge of that level: a replay still finds it, and so does
a reader that listed it.  Folders count once their write is committed.  A
restart resumes from the checkpoint.  ``trigger(availableNow=True)`` processes
what is there and stops (tests, catch-up jobs); a long-running deployment uses
``processingTime`` instead.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.operators import report
from slimctx.sources.usage_log import stream_log


FANOUT = 16


def _folder(out: str, level: int, index: int) -> str:
    return f"{out}/level{level}-{index}"


def _committed(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """(level, index) of the folders whose write has ended."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = [(n, re.fullmatch(r"level(\d+)-(\d+)", n)) for n in names]
    return [(int(m[1]), int(m[2])) for n, m in found
            if m and fs.exists(jvm.Path(f"{out}/{n}/_SUCCESS"))]


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def covering(folders: list[tuple[int, int]], fanout: int) -> list[tuple[int, int]]:
    """The folders to read: each batch once, in its highest merge."""
    taken, covered = [], 0
    for level, index in sorted(folders, key=lambda f: (f[1] * fanout ** f[0], -f[0])):
        if index * fanout ** level >= covered:
            taken.append((level, index))
            covered = (index + 1) * fanout ** level
    return taken


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = F.struct(*[c for c in rows.columns if c not in keys and c != "batch"])
    return (rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v"), F.max("batch").alias("batch"))
            .select(*keys, "v.*", "batch"))


def write_batch(batch: DataFrame, batch_id: int, out: str, keys: list[str] | None = None,
                fanout: int = FANOUT) -> None:
    """Write a micro-batch; with ``keys``, merge the groups that it completes."""
    spark = batch.sparkSession
    (batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").parquet(_folder(out, 0, batch_id)))
    level, index = 0, batch_id
    while keys is not None and index % fanout == fanout - 1:
        group = index // fanout
        parts = [f for f in _committed(spark, out) if f[0] == level and f[1] // fanout == group]
        rows = spark.read.parquet(*[_folder(out, *f) for f in parts])
        _latest(rows, keys).write.mode("overwrite").parquet(_folder(out, level + 1, group))
        for f in _committed(spark, out):
            if f[0] == level and f[1] // fanout < group:
                _drop(spark, _folder(out, *f))
        level, index = level + 1, group


def read_series(spark: SparkSession, out: str, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """The latest row of every key."""
    folders = covering(_committed(spark, out), fanout)
    return _latest(spark.read.parquet(*[_folder(out, *f) for f in folders]), keys).drop("batch")


def _run(agg: DataFrame, out: str, ckpt: str, keys: list[str], available_now: bool = True,
         processing_time: str | None = None):
    w = (agg.writeStream.outputMode("update")
         .option("checkpointLocation", ckpt)
         .foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out, keys)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    return w.start()


def _agg_totals(log: DataFrame) -> DataFrame:
    return report.totals(log)


def _agg_days(log: DataFrame) -> DataFrame:
    return (log.groupBy(report.day_of(F.col("ts")).alias("day"))
            .agg(F.sum(F.coalesce(F.col("tokens_saved"), F.lit(0))).cast("bigint").alias("day_saved")))


def _running(days: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select("day", "day_saved", F.sum("day_saved").over(w).cast("bigint").alias("cumulative_saved"))


def _agg_files(log: DataFrame) -> DataFrame:
    return report.per_file_saved(log)


def _agg_hist(log: DataFrame) -> DataFrame:
    return (log.groupBy(report.bucket_of(report.reduction_or_zero()).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("runs")))


#: name -> (aggregate, key columns, what is applied when the series is read)
SERIES = {
    "totals": (_agg_totals, [], None),
    "daily_cumulative": (_agg_days, ["day"], _running),
    "per_file": (_agg_files, ["file"], None),
    "histogram": (_agg_hist, ["bucket"], None),
}


def start_series(spark: SparkSession, log_dir: str, work_dir: str, series: str,
                 max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start one dashboard series as a streaming query over ``log_dir``; its
    batches land in ``work_dir/<series>/out`` (see ``read_series``)."""
    log = stream_log(spark, log_dir, max_files_per_trigger)
    out = os.path.join(work_dir, series, "out")
    ckpt = os.path.join(work_dir, series, "checkpoint")
    return _run(SERIES[series][0](log), out, ckpt, SERIES[series][1], available_now), out


def catch_up(spark: SparkSession, log_dir: str, work_dir: str, series: str,
             max_files_per_trigger: int | None = None) -> DataFrame:
    """Process every file present now (incrementally, resuming from the
    checkpoint) and return the series table."""
    q, out = start_series(spark, log_dir, work_dir, series, max_files_per_trigger, True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    _, keys, post = SERIES[series]
    rows = read_series(spark, out, keys)
    return post(rows) if post else rows
