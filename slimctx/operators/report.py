"""Usage-log analytics: the dashboard series, each a small DataFrame.

All of them are one partial+final hash aggregate over the log; the only
single-partition step (the running total by day) runs after the day
aggregate, so it sees one row per day, never raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The ten histogram bucket labels of the dashboard.
BUCKET_LABELS = ["0-10", "10-20", "20-30", "30-40", "40-50",
                 "50-60", "60-70", "70-80", "80-90", "90-100"]

UNKNOWN_FILE = "<unknown>"
UNKNOWN_DAY = "unknown"

# Exact averaging: sum a DECIMAL so the mean does not depend on the order in
# which partitions are combined.
_EXACT = "decimal(38,12)"


def _n(c: str) -> Column:
    """A numeric field, missing → 0 (the loader's ``get(field, 0)``)."""
    return F.coalesce(F.col(c), F.lit(0))


def reduction_or_zero() -> Column:
    return F.coalesce(F.col("reduction_pct"), F.lit(0.0))


def day_of(ts: Column) -> Column:
    """First ten characters of the ISO stamp, else ``unknown``."""
    return F.when(F.length(ts) >= 10, F.substring(ts, 1, 10)).otherwise(F.lit(UNKNOWN_DAY))


def totals(log: DataFrame) -> DataFrame:
    """Count and three sums; an empty log gives one row of zeros."""
    return log.agg(
        F.count(F.lit(1)).alias("total_invocations"),
        F.coalesce(F.sum(_n("baseline_tokens")), F.lit(0)).cast("bigint").alias("total_baseline_tokens"),
        F.coalesce(F.sum(_n("pruned_tokens")), F.lit(0)).cast("bigint").alias("total_pruned_tokens"),
        F.coalesce(F.sum(_n("tokens_saved")), F.lit(0)).cast("bigint").alias("total_tokens_saved"),
    )


def mean_reduction(log: DataFrame) -> DataFrame:
    """Unweighted mean of per-run reduction (missing counts as 0) beside the
    weighted one (saved over baseline across all runs)."""
    return log.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.round(F.avg(reduction_or_zero().cast(_EXACT)), 2), F.lit(0))
         .cast("double").alias("avg_reduction_pct"),
        F.round(F.when(F.sum(_n("baseline_tokens")) > 0,
                       F.sum(_n("tokens_saved")).cast(_EXACT) * 100 / F.sum(_n("baseline_tokens"))),
                2).cast("double").alias("weighted_reduction_pct"),
    )


def token_split(log: DataFrame) -> DataFrame:
    """Pruned vs saved tokens as two labelled rows (the doughnut chart)."""
    t = totals(log)
    return t.select(F.expr("stack(2, 'pruned', total_pruned_tokens, 'saved', total_tokens_saved)")
                    .alias("part", "tokens"))


def per_file_saved(log: DataFrame) -> DataFrame:
    f = F.coalesce(F.col("file"), F.lit(UNKNOWN_FILE))
    return log.groupBy(f.alias("file")).agg(F.sum(_n("tokens_saved")).cast("bigint").alias("tokens_saved"))


def top_files(log: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` files by saved tokens; ties broken by file name.  The limit
    is the feature here (a top-k report): Spark plans it as a per-partition
    top-n followed by one small merge."""
    return (per_file_saved(log)
            .orderBy(F.col("tokens_saved").desc(), F.col("file").asc())
            .limit(n)
            .select("file",
                    F.substring_index("file", "/", -2).alias("label"),
                    F.substring_index("file", "/", -1).alias("basename"),
                    F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1)).alias("ext"),
                    "tokens_saved"))


def daily_cumulative(log: DataFrame) -> DataFrame:
    """Saved tokens per day and the running total in day order
    (``unknown`` sorts after the dates)."""
    per_day = (log.groupBy(day_of(F.col("ts")).alias("day"))
               .agg(F.sum(_n("tokens_saved")).cast("bigint").alias("day_saved")))
    # One row per day reaches this window: the single partition is tiny.
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.select("day", "day_saved", F.sum("day_saved").over(w).cast("bigint").alias("cumulative_saved"))


def bucket_of(r: Column) -> Column:
    """10-point bucket 0..9; 100 % and above go to the last bucket, negative
    values are clamped to the first (a declared deviation)."""
    return F.greatest(F.least(F.floor(r / 10).cast("int"), F.lit(9)), F.lit(0))


def reduction_histogram(log: DataFrame) -> DataFrame:
    """Dense histogram: all ten buckets, empty ones as 0."""
    spark = log.sparkSession
    counts = (log.groupBy(bucket_of(reduction_or_zero()).alias("bucket"))
              .agg(F.count(F.lit(1)).alias("runs")))
    labels = F.array(*[F.lit(x) for x in BUCKET_LABELS])
    # ten rows on the left; the right side has at most ten rows as well
    return (spark.range(0, 10).select(F.col("id").cast("int").alias("bucket"))
            .join(F.broadcast(counts), "bucket", "left")
            .select("bucket", F.get(labels, F.col("bucket")).alias("label"),
                    F.coalesce(F.col("runs"), F.lit(0)).cast("bigint").alias("runs")))


def weighted_by_request(log: DataFrame) -> DataFrame:
    """Totals per multi-file request: Σsaved/Σbaseline, only when the request
    covered more than one file and its baseline is positive."""
    g = (log.groupBy("request_id")
         .agg(F.count(F.lit(1)).alias("files"),
              F.sum(_n("baseline_tokens")).cast("bigint").alias("baseline_tokens"),
              F.sum(_n("pruned_tokens")).cast("bigint").alias("pruned_tokens"),
              F.sum(_n("tokens_saved")).cast("bigint").alias("tokens_saved"),
              F.sum(_n("files_traversed")).cast("bigint").alias("files_traversed")))
    return g.withColumn(
        "weighted_reduction_pct",
        F.when((F.col("files") > 1) & (F.col("baseline_tokens") > 0),
               F.round(F.col("tokens_saved").cast(_EXACT) * 100 / F.col("baseline_tokens"), 2)
               .cast("double")))


def report(log: DataFrame) -> dict[str, DataFrame]:
    """Every series of the dashboard, by name."""
    return {"totals": totals(log), "means": mean_reduction(log), "token_split": token_split(log),
            "top_files": top_files(log), "daily_cumulative": daily_cumulative(log),
            "histogram": reduction_histogram(log)}


def write_report(log: DataFrame, path: str) -> None:
    """Write the series as one dataset: a parquet table each below ``path``."""
    for name, df in report(log).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
