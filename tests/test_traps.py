import re

from pyspark.sql import functions as F

from slimctx.functions.text import IDENT_RE, identifiers
from slimctx.operators import report
from slimctx.sources.usage_log import LOG_SCHEMA


def test_top10_ties_broken_by_file(spark):
    rows = [(f"src/f{i:02d}.py", 5) for i in range(12)] + [("src/big.py", 9)]
    log = spark.createDataFrame(rows, "file string, tokens_saved long")
    for c in LOG_SCHEMA.fieldNames():
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast(LOG_SCHEMA[c].dataType))
    top = [r.file for r in report.top_files(log).collect()]
    assert top == ["src/big.py"] + [f"src/f{i:02d}.py" for i in range(9)]


def test_identifiers_match_python_re_on_non_ascii(spark):
    samples = ["café x_1 $dollar a$b", "naïve = résumé + ok", "über_all(y) // ñ z9"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [sorted(r.ids) for r in df.select(identifiers(F.col("t")).alias("ids")).collect()]
    want = [sorted(set(re.findall(IDENT_RE, s))) for s in samples]
    assert got == want


def test_symbols_from_prompt(spark):
    from slimctx.functions.text import symbols_from_prompt
    prompts = ["prune --symbols greet, Config please", "symbols= a,b", "symbols=a,b", "nothing here"]
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    got = [list(r.s) for r in df.select(symbols_from_prompt(F.col("p")).alias("s")).collect()]
    # the pattern needs whitespace after the marker and swallows trailing words
    assert got == [["greet", "Config please"], ["a", "b"], [], []]


def test_render_json_structure(spark):
    import json

    from slimctx.plans.api import CorpusIndex, render_json
    from conftest import make_files
    from fixtures import PY_APP
    idx = CorpusIndex(make_files(spark, PY_APP))
    seeds = idx.seeds(["sky/plan.py"], "schedule")
    doc = json.loads(render_json(idx.prune(seeds), seeds).first().json)
    assert list(doc) == ["entry", "requested_symbols", "total_tokens", "files"]
    assert doc["requested_symbols"] == ["schedule"]
    assert [f["depth"] for f in doc["files"]] == [0, 1] and doc["files"][0]["is_entry"]
    assert doc["total_tokens"] == sum(f["estimated_tokens"] for f in doc["files"])
