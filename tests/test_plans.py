"""Physical-plan checks: everything stays JVM-side, and the one
single-partition window runs on aggregated rows only."""

from slimctx.operators import report
from slimctx.plans.api import CorpusIndex
from slimctx.sources.usage_log import LOG_SCHEMA
from conftest import make_files
from fixtures import JS_APP, PY_APP, TS_APP

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas")


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sweep_has_no_python_nodes(spark):
    idx = CorpusIndex(make_files(spark, {**PY_APP, **JS_APP, **TS_APP}))
    b, f = idx.benchmark(idx.seeds())
    for df in (idx.parsed, b, f, idx.prune(idx.seeds())):
        plan = _plan(df)
        assert not any(n in plan for n in PYTHON_NODES)


def test_global_window_only_after_aggregation(spark):
    log = spark.createDataFrame([], LOG_SCHEMA)
    plan = _plan(report.daily_cumulative(log))
    lines = plan.split("\n")
    w = [i for i, l in enumerate(lines) if "Window [" in l]
    assert w, plan
    below = "\n".join(lines[w[0]:])
    assert "HashAggregate" in below                 # the window reads the day aggregate
