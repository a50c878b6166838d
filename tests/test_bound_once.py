"""Work that must be done once: per array, per file, per text."""

from pyspark.sql import functions as F

from conftest import make_files
from slimctx.operators import prune as P
from slimctx.operators.extract import _cut, _running, parse_files, symbols_table
from slimctx.operators.resolve import candidates
from slimctx.plans.api import CorpusIndex, _per_entry, render_json, render_text
from slimctx.plans.corpus_queries import q_used_imports

FILES = {
    "src/a.py": "from .b import f, g as gg\nimport os\n\n\ndef run(x):\n    # f is not far,\n    # most of it is close\n"
                "    return f(x)\n\n\ndef other():\n    # gg\n    return 1\n",
    "src/b.py": "from .a import run\n\ndef f(x):\n    # a dog's life\n    return run(x)\n\ndef g(): return f(1)\n",
}


def plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")     # whole
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_steps_of_a_running_sum_are_computed_once(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.col("id") + 200).alias("xs"), F.lit("a").alias("t"))
    steps = F.transform("xs", lambda x: (x % 7919).cast("int"))
    total = df.select(_running(steps, lambda at: at(F.lit(200))).alias("r"))
    assert total.first().r == 200 * 201 // 2
    assert plan(total).count("7919") == 1
    pieces = df.select(_cut(F.repeat("t", 30_000), steps).alias("r"))
    assert [len(x) for x in pieces.first().r] == list(range(1, 201))
    assert plan(pieces).count("7919") == 1


def test_names_are_found_in_any_line_of_a_symbol(spark):
    rows = symbols_table(parse_files(make_files(spark, FILES))).collect()
    assert {(r.path, r.name): list(r.used) for r in rows} == {
        ("src/a.py", "run"): ["f"], ("src/a.py", "other"): ["gg"],
        ("src/b.py", "f"): ["run"], ("src/b.py", "g"): []}


def test_candidates_compute_the_joined_path_once(spark):
    df = spark.createDataFrame([("src/x/a.js", "javascript", "../b/c")], "path string, language string, specifier string")
    got = df.repartition(1).select(candidates(F.col("path"), F.col("language"), F.col("specifier")).alias("c"))
    assert [x.cand for x in got.first().c][:2] == ["src/b/c", "src/b/c.js"]
    assert plan(got).count("specifier#") < 40


def test_rewriting_binds_its_arrays(spark):
    parsed = parse_files(make_files(spark, FILES)).localCheckpoint()
    got = P.used_import_statements(parsed, P.default_request(parsed))
    assert {r.path: list(r.stmts) for r in got.collect()} == {
        "src/a.py": ["from .b import f, g as gg"], "src/b.py": ["from .a import run"]}
    assert plan(got.select("stmts")).count("array_contains") <= 2


def test_texts_are_read_and_shuffled_for_entries_only(spark):
    idx = CorpusIndex(make_files(spark, FILES))
    seeds = idx.seeds()
    assert "text" not in idx.slim.schema["symbols"].dataType.elementType.names
    read = seeds._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in read and "texts" not in read
    names = lambda df: df.schema["symbols"].dataType.elementType.names
    assert names(idx.parsed) == names(parse_files(make_files(spark, FILES)))
    pruned = idx.prune(seeds)
    shown = {(r.entry, r.path): r.source for r in pruned.collect()}
    assert "return f(x)" in shown["src/a.py", "src/a.py"]
    assert "return" not in shown["src/b.py", "src/a.py"] and "def run(x):" in shown["src/b.py", "src/a.py"]
    # the documents of all entries are streamed past the requests, not sorted
    assert plan(render_json(pruned, seeds)).lower().count("shuffle_hash") >= 3


def test_texts_of_entries_are_not_shuffled_again_for_the_documents(spark):
    idx = CorpusIndex(make_files(spark, FILES))
    seeds = idx.seeds()
    pruned = idx.prune(seeds)
    own, others = _per_entry(pruned, F.col("source"))
    # the requests and the texts, each dealt out by entry once
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(entry") == 2
    for docs in (render_text(pruned), render_json(pruned, seeds)):
        assert "Union" not in plan(docs) and docs.count() == 2
    text = {r.entry: r for r in render_text(pruned).collect()}["src/a.py"]
    assert text.text.index("# === src/a.py (") < text.text.index("# === src/b.py (") and text.files == 2
    assert text.total_tokens == pruned.where("entry = 'src/a.py'").agg(F.sum("estimated_tokens")).first()[0]
    # entries whose own file was left out, and entries that reach nothing else
    alone = render_text(pruned.where("not is_entry")).collect()
    assert {r.entry: r.files for r in alone} == {"src/a.py": 1, "src/b.py": 1}
    assert render_json(pruned.where("not is_entry"), seeds).count() == 2
    assert {r.files for r in render_text(pruned.where("is_entry")).collect()} == {1}


def test_used_imports_parses_each_file_once(spark, tmp_path):
    rows = [(i, "en" if i % 2 else "fr", f"some words of {i}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = q_used_imports(spark, str(tmp_path))
    assert got.count() == 12
    assert "regexp_extract_all" not in plan(got)
