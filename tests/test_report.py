import json

import pytest
from fixtures import RUNS
from pyspark.sql import functions as F

from slimctx.operators import report
from slimctx.sources.usage_log import LOG_SCHEMA, read_log


def _log(spark, tmp_path, rows, extra_lines=()):
    p = tmp_path / "log"
    p.mkdir()
    (p / "part-0.json").write_text("".join(json.dumps(r) + "\n" for r in rows)
                                   + "".join(x + "\n" for x in extra_lines))
    return read_log(spark, str(p))


def test_totals_and_means(spark, tmp_path):
    log = _log(spark, tmp_path, RUNS)
    assert tuple(report.totals(log).first()) == (4, 2000, 776, 1224)
    m = report.mean_reduction(log).first()
    assert m.avg_reduction_pct == pytest.approx(50.34)        # (25 + 91 + 42.5 + 42.86) / 4
    assert m.weighted_reduction_pct == pytest.approx(61.2)    # 1224 / 2000
    assert {r.part: r.tokens for r in report.token_split(log).collect()} == {"pruned": 776, "saved": 1224}


def test_files_days_and_histogram(spark, tmp_path):
    log = _log(spark, tmp_path, RUNS)
    assert [(r.file, r.tokens_saved) for r in report.top_files(log).collect()] == [
        ("sky/plan.py", 910), ("ferry/board.ts", 194), ("seeds/scale.js", 120)]
    assert [tuple(r) for r in report.daily_cumulative(log).orderBy("day").collect()] == [
        ("2031-03-04", 1070, 1070), ("2031-03-05", 120, 1190), ("2031-03-06", 34, 1224)]
    hist = {r.label: r.runs for r in report.reduction_histogram(log).collect()}
    assert {k: v for k, v in hist.items() if v} == {"20-30": 1, "40-50": 2, "90-100": 1}
    assert len(hist) == 10


def test_report_returns_and_writes_every_series(spark, tmp_path):
    log = _log(spark, tmp_path, RUNS)
    series = report.report(log)
    out = str(tmp_path / "series")
    report.write_report(log, out)
    for name, df in series.items():
        back = spark.read.parquet(f"{out}/{name}")
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert set(series) == {"totals", "means", "token_split", "top_files", "daily_cumulative", "histogram"}


def test_loader_tolerance(spark, tmp_path):
    log = _log(spark, tmp_path, RUNS[1:2], ["", "{broken", "[]", "17", '{"tokens_saved": 9}'])
    assert log.count() == 2
    assert report.totals(log).first().total_tokens_saved == 919


def test_missing_log_is_empty(spark, tmp_path):
    log = read_log(spark, str(tmp_path / "nope"))
    assert log.count() == 0
    assert tuple(report.totals(log).first()) == (0, 0, 0, 0)


def test_edges_of_histogram_and_days(spark):
    rows = [("x", None, -5.0), (None, "f", 100.0), ("2031-01-01T00:00:00Z", "f", 99.9)]
    log = spark.createDataFrame(rows, "ts string, file string, reduction_pct double")
    for c in LOG_SCHEMA.fieldNames():
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast(LOG_SCHEMA[c].dataType))
    hist = {r.bucket: r.runs for r in report.reduction_histogram(log).collect()}
    assert hist[0] == 1 and hist[9] == 2            # negative clamped, 100 % in last bucket
    days = {r.day for r in report.daily_cumulative(log).collect()}
    assert days == {"unknown", "2031-01-01"}
    assert "<unknown>" in {r.file for r in report.top_files(log).collect()}
