"""DuckDB oracle SQL for the usage-log queries (log ``L`` derived from
``events``).  Written independently of the Spark code, in plain SQL."""

LOG_CTE = """
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(floor(value * 10) AS BIGINT) + 1 AS b
  FROM events
),
L AS (
  SELECT CASE WHEN event_id % 97 = 0 THEN NULL
              WHEN event_id % 101 = 0 THEN 'x'
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS ts,
         CASE WHEN event_id % 89 = 0 THEN NULL
              ELSE 'src/' || event_type || '/u' || CAST(user_id AS VARCHAR) || '.py' END AS file,
         k % 4 AS depth,
         b AS baseline_tokens,
         b * k // 100 AS pruned_tokens,
         b - b * k // 100 AS tokens_saved,
         (b - b * k // 100) / b * 100 AS reduction_pct,
         1 + k % 7 AS files_traversed,
         user_id AS request_id,
         event_id
  FROM ev
)"""


def _with(body: str) -> str:
    return "WITH " + LOG_CTE + "\n" + body


LOG_SQL = {
    "log_totals": _with("""
SELECT count(*) AS total_invocations,
       CAST(coalesce(sum(coalesce(baseline_tokens, 0)), 0) AS BIGINT) AS total_baseline_tokens,
       CAST(coalesce(sum(coalesce(pruned_tokens, 0)), 0) AS BIGINT) AS total_pruned_tokens,
       CAST(coalesce(sum(coalesce(tokens_saved, 0)), 0) AS BIGINT) AS total_tokens_saved
FROM L"""),
    "log_mean_reduction": _with("""
SELECT count(*) AS runs,
       CAST(coalesce(round(avg(CAST(coalesce(reduction_pct, 0.0) AS DECIMAL(38,12))), 2), 0) AS DOUBLE)
         AS avg_reduction_pct,
       CAST(round(CASE WHEN sum(baseline_tokens) > 0
                       THEN CAST(sum(tokens_saved) AS DECIMAL(38,12)) * 100 / sum(baseline_tokens) END, 2)
            AS DOUBLE) AS weighted_reduction_pct
FROM L"""),
    "log_token_split": _with("""
SELECT 'pruned' AS part, CAST(sum(pruned_tokens) AS BIGINT) AS tokens FROM L
UNION ALL
SELECT 'saved' AS part, CAST(sum(tokens_saved) AS BIGINT) AS tokens FROM L"""),
    "log_top_files": _with("""
, per_file AS (
  SELECT coalesce(file, '<unknown>') AS file, CAST(sum(coalesce(tokens_saved, 0)) AS BIGINT) AS tokens_saved
  FROM L GROUP BY 1
)
SELECT file,
       array_to_string(list_slice(string_split(file, '/'), -2, -1), '/') AS label,
       string_split(file, '/')[-1] AS basename,
       lower(regexp_extract(file, '(\\.[^./]+)$', 1)) AS ext,
       tokens_saved
FROM per_file ORDER BY tokens_saved DESC, file ASC LIMIT 10"""),
    "log_daily_cumulative": _with("""
, per_day AS (
  SELECT CASE WHEN length(ts) >= 10 THEN substr(ts, 1, 10) ELSE 'unknown' END AS day,
         CAST(sum(coalesce(tokens_saved, 0)) AS BIGINT) AS day_saved
  FROM L GROUP BY 1
)
SELECT day, day_saved,
       CAST(sum(day_saved) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS cumulative_saved
FROM per_day"""),
    "log_reduction_histogram": _with("""
, b AS (
  SELECT greatest(least(CAST(floor(coalesce(reduction_pct, 0.0) / 10) AS INTEGER), 9), 0) AS bucket,
         count(*) AS runs
  FROM L GROUP BY 1
)
SELECT r.bucket,
       ['0-10','10-20','20-30','30-40','40-50','50-60','60-70','70-80','80-90','90-100'][r.bucket + 1] AS label,
       CAST(coalesce(b.runs, 0) AS BIGINT) AS runs
FROM (SELECT CAST(range AS INTEGER) AS bucket FROM range(0, 10)) r LEFT JOIN b USING (bucket)"""),
    "batch_weighted_reduction": _with("""
SELECT request_id,
       count(*) AS files,
       CAST(sum(coalesce(baseline_tokens, 0)) AS BIGINT) AS baseline_tokens,
       CAST(sum(coalesce(pruned_tokens, 0)) AS BIGINT) AS pruned_tokens,
       CAST(sum(coalesce(tokens_saved, 0)) AS BIGINT) AS tokens_saved,
       CAST(sum(coalesce(files_traversed, 0)) AS BIGINT) AS files_traversed,
       CASE WHEN count(*) > 1 AND sum(baseline_tokens) > 0
            THEN CAST(round(CAST(sum(tokens_saved) AS DECIMAL(38,12)) * 100 / sum(baseline_tokens), 2) AS DOUBLE)
       END AS weighted_reduction_pct
FROM L GROUP BY request_id"""),
    # the noisy text file holds every log row once; blank / garbage / scalar
    # lines must all be dropped by the reader
    "log_malformed_lines": _with("""
SELECT count(*) AS good_lines,
       CAST(sum(coalesce(tokens_saved, 0)) AS BIGINT) AS tokens_saved,
       count(ts) AS with_ts, count(file) AS with_file
FROM L"""),
}

# the streamed series must equal the batch ones
LOG_SQL["stream_log_totals"] = LOG_SQL["log_totals"]
LOG_SQL["stream_daily_cumulative"] = LOG_SQL["log_daily_cumulative"]
LOG_SQL["stream_per_file"] = _with("""
SELECT coalesce(file, '<unknown>') AS file, CAST(sum(coalesce(tokens_saved, 0)) AS BIGINT) AS tokens_saved
FROM L GROUP BY 1""")
LOG_SQL["stream_histogram"] = _with("""
SELECT greatest(least(CAST(floor(coalesce(reduction_pct, 0.0) / 10) AS INTEGER), 9), 0) AS bucket, count(*) AS runs
FROM L GROUP BY 1""")
