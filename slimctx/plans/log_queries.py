"""Registered log-analytics queries: each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.operators import report
from slimctx.session import scratch_dir
from slimctx.sources.tables import table
from slimctx.sources.usage_log import log_from_events, log_lines_with_noise, read_log


def derived_log(spark: SparkSession, sf_dir: str, keep_event_id: bool = False) -> DataFrame:
    return log_from_events(table(spark, sf_dir, "events"), keep_event_id)


def q_log_totals(spark, sf_dir):
    return report.totals(derived_log(spark, sf_dir))


def q_log_mean_reduction(spark, sf_dir):
    return report.mean_reduction(derived_log(spark, sf_dir))


def q_log_token_split(spark, sf_dir):
    return report.token_split(derived_log(spark, sf_dir))


def q_log_top_files(spark, sf_dir):
    return report.top_files(derived_log(spark, sf_dir), 10)


def q_log_daily_cumulative(spark, sf_dir):
    return report.daily_cumulative(derived_log(spark, sf_dir))


def q_log_reduction_histogram(spark, sf_dir):
    return report.reduction_histogram(derived_log(spark, sf_dir))


def q_batch_weighted_reduction(spark, sf_dir):
    return report.weighted_by_request(derived_log(spark, sf_dir))


def q_log_malformed_lines(spark, sf_dir):
    """Write the log as text with blank, garbage and scalar lines mixed in,
    read it back with the tolerant reader and total it."""
    out = scratch_dir(spark, "noisy-log")
    log_lines_with_noise(derived_log(spark, sf_dir, keep_event_id=True)).write.text(out)
    log = read_log(spark, out)
    return log.agg(F.count(F.lit(1)).alias("good_lines"),
                   F.sum(F.coalesce("tokens_saved", F.lit(0))).cast("bigint").alias("tokens_saved"),
                   F.count("ts").alias("with_ts"),
                   F.count("file").alias("with_file"))


def _streamed(spark, sf_dir, series):
    """The derived log arrives as files in two waves (two groups of event
    types, i.e. two sources appending to one folder); the streaming query
    catches up after the first wave, then restarts from its checkpoint and
    folds in the second.  Every row is processed exactly once."""
    import os
    from slimctx.streaming.log_stream import catch_up
    events = table(spark, sf_dir, "events")
    work = scratch_dir(spark, f"stream-{series}")
    log_dir = os.path.join(work, "log")
    # a null event type is in the second wave
    first = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    for wave in (first, ~first):
        (log_from_events(events.where(wave))
         .write.mode("append").json(log_dir))
        result = catch_up(spark, log_dir, work, series)
    return result


def q_stream_log_totals(spark, sf_dir):
    return _streamed(spark, sf_dir, "totals")


def q_stream_daily_cumulative(spark, sf_dir):
    return _streamed(spark, sf_dir, "daily_cumulative")


def q_stream_per_file(spark, sf_dir):
    return _streamed(spark, sf_dir, "per_file")


def q_stream_histogram(spark, sf_dir):
    return _streamed(spark, sf_dir, "histogram")


LOG_QUERIES = {
    "log_totals": q_log_totals,
    "log_mean_reduction": q_log_mean_reduction,
    "log_token_split": q_log_token_split,
    "log_top_files": q_log_top_files,
    "log_daily_cumulative": q_log_daily_cumulative,
    "log_reduction_histogram": q_log_reduction_histogram,
    "batch_weighted_reduction": q_batch_weighted_reduction,
    "log_malformed_lines": q_log_malformed_lines,
    "stream_log_totals": q_stream_log_totals,
    "stream_daily_cumulative": q_stream_daily_cumulative,
    "stream_per_file": q_stream_per_file,
    "stream_histogram": q_stream_histogram,
}
