"""Usage log: one JSON object per line, as the editor side appends it.

* ``LOG_SCHEMA`` — the explicit schema every reader uses (no inference).
* ``read_log`` — batch reader that skips blank, non-JSON and non-object
  lines and turns a missing folder into an empty table.
* ``append_log`` — append rows (e.g. a benchmark projection) as JSON lines.
* ``log_from_events`` — the test log derived from the ``events`` table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("depth", T.LongType()),
    T.StructField("baseline_tokens", T.LongType()),
    T.StructField("pruned_tokens", T.LongType()),
    T.StructField("tokens_saved", T.LongType()),
    T.StructField("reduction_pct", T.DoubleType()),
    T.StructField("files_traversed", T.LongType()),
    # request id: rows of one multi-file request share it (weighted totals)
    T.StructField("request_id", T.LongType()),
])

LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON-lines log folder/file.

    DROPMALFORMED drops lines that are not JSON objects (garbage text and
    scalars); blank lines produce no record.  A field of the wrong type
    makes the whole line malformed and it is dropped too.  A missing
    path yields an empty table with the log schema.
    """
    try:
        return (spark.read.schema(LOG_SCHEMA)
                .option("mode", "DROPMALFORMED")
                .json(path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or "") or "Path does not exist" in str(e):
            return spark.createDataFrame([], LOG_SCHEMA)
        raise


def stream_log(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same log as an unbounded stream (new files in the folder)."""
    reader = spark.readStream.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to the log folder as JSON lines (one new file per task)."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast(LOG_SCHEMA[c].dataType).alias(c)
            for c in LOG_COLUMNS]
    df.select(*cols).write.mode("append").json(path)


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def log_from_events(events: DataFrame, keep_event_id: bool = False) -> DataFrame:
    """Derive usage-log rows from ``events`` (a narrow projection, no shuffle).

    Every 97th event has no ``ts``, every 101st a garbage ``ts``; every
    89th has no ``file``.  ``user_id`` acts as the request id.
    """
    e = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = _k(F.col("props"))
    baseline = (F.floor(F.col("value") * 10).cast("bigint") + 1)
    iso = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return (e
            .withColumn("k", k)
            .withColumn("baseline_tokens", baseline)
            .select(
                F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
                 .when(F.col("event_id") % 101 == 0, F.lit("x"))
                 .otherwise(iso).alias("ts"),
                F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("src/"), F.col("event_type"), F.lit("/u"),
                                     F.col("user_id").cast("string"), F.lit(".py"))).alias("file"),
                F.array(F.col("event_type")).alias("symbols"),
                (F.col("k") % 4).alias("depth"),
                F.col("baseline_tokens"),
                F.expr("baseline_tokens * k div 100").alias("pruned_tokens"),
                F.expr("baseline_tokens - baseline_tokens * k div 100").alias("tokens_saved"),
                F.expr("(baseline_tokens - baseline_tokens * k div 100) / baseline_tokens * 100")
                 .alias("reduction_pct"),
                (F.lit(1) + F.col("k") % 7).cast("bigint").alias("files_traversed"),
                F.col("user_id").alias("request_id"),
                *([F.col("event_id")] if keep_event_id else []),
            ))


def log_lines_with_noise(log_with_id: DataFrame) -> DataFrame:
    """JSON text lines of the log plus noise, as one ``value`` column for
    ``write.text``: after every 7th row a blank line, every 11th a
    ``not json`` line, every 13th a bare scalar ``42``.  Needs ``event_id``
    (``log_from_events(..., keep_event_id=True)``)."""
    line = F.to_json(F.struct(*[F.col(c) for c in LOG_COLUMNS]))
    i = F.col("event_id")
    lines = F.array(
        line,
        F.when(i % 7 == 0, F.lit("")),
        F.when(i % 11 == 0, F.lit("not json")),
        F.when(i % 13 == 0, F.lit("42")),
    )
    return log_with_id.select(F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("value"))
