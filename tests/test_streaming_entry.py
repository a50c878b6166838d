import json
import os

from slimctx.streaming.log_stream import catch_up
from fixtures import RUNS


def test_stream_equals_batch_after_restart(spark, tmp_path):
    log_dir, work = str(tmp_path / "log"), str(tmp_path / "work")
    os.makedirs(log_dir)
    for i, rows in enumerate((RUNS[:3], RUNS[3:])):
        with open(os.path.join(log_dir, f"part-{i}.json"), "w") as f:
            for r in rows:
                f.write(json.dumps(r) + "\n")
        tot = catch_up(spark, log_dir, work, "totals").first()
        days = catch_up(spark, log_dir, work, "daily_cumulative")
        files = catch_up(spark, log_dir, work, "per_file")
        hist = catch_up(spark, log_dir, work, "histogram")
    assert (tot.total_invocations, tot.total_tokens_saved) == (4, 1224)
    assert [(r.day, r.cumulative_saved) for r in days.orderBy("day").collect()] == \
        [("2031-03-04", 1070), ("2031-03-05", 1190), ("2031-03-06", 1224)]
    assert {r.file: r.tokens_saved for r in files.collect()} == {
        "sky/plan.py": 910, "ferry/board.ts": 194, "seeds/scale.js": 120}
    assert {r.bucket: r.runs for r in hist.collect()} == {2: 1, 4: 2, 9: 1}


def test_a_batch_that_is_written_again_changes_nothing(spark, tmp_path):
    """Results are kept by batch id, so a replay after a failure between the
    write and the commit replaces its own output."""
    from slimctx.streaming.log_stream import read_series, write_batch
    out = str(tmp_path / "out")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "file string, tokens_saved long")
    two = spark.createDataFrame([("a", 5)], "file string, tokens_saved long")
    write_batch(one, 0, out)
    write_batch(two, 1, out)
    write_batch(two, 1, out)
    got = {r.file: r.tokens_saved for r in read_series(spark, out, ["file"]).collect()}
    assert got == {"a": 5, "b": 2}


def test_merged_batches(spark, tmp_path):
    """Levels of merged folders: any number of batches, replays across a
    merge and an unfinished merge give the latest row of every key."""
    from slimctx.streaming import log_stream as S
    out, latest = str(tmp_path / "out"), {}

    def write(b):
        rows = [(f"f{b % 5}", b), (None if b % 3 else "g", 10 * b)]
        S.write_batch(spark.createDataFrame(rows, "file string, tokens_saved long").coalesce(1), b, out, ["file"], 3)
        latest.update(rows)

    for b in range(29):
        write(b)
        if b in (8, 9, 26):
            write(b)                              # replayed, its merges included
        if b in (0, 7, 8, 9, 26, 28):
            got = {r.file: r.tokens_saved for r in S.read_series(spark, out, ["file"], 3).collect()}
            assert got == latest
    folders = S._committed(spark, out)
    assert S.covering(folders, 3) == [(3, 0), (0, 27), (0, 28)]
    assert len(folders) <= 2 * 3 * 4
    os.remove(os.path.join(S._folder(out, 3, 0), "_SUCCESS"))      # a merge that did not end
    assert S.covering(S._committed(spark, out), 3) == [(2, 0), (2, 1), (2, 2), (0, 27), (0, 28)]
    got = {r.file: r.tokens_saved for r in S.read_series(spark, out, ["file"], 3).collect()}
    assert got == latest


def test_folders_read_stay_few():
    from slimctx.streaming.log_stream import covering
    every = [(level, i) for level in range(3) for i in range(1000 // 16 ** level)]
    taken = covering(every, 16)
    assert len(taken) <= 3 * 15
    assert sum(16 ** level for level, _ in taken) == 1000


def test_totals_without_keys_restart_across_a_merge(spark, tmp_path):
    log_dir, work = str(tmp_path / "log"), str(tmp_path / "work")
    os.makedirs(log_dir)
    for half in (range(10), range(10, 20)):
        for i in half:
            with open(os.path.join(log_dir, f"part-{i:02d}.json"), "w") as f:
                f.write(json.dumps(RUNS[i % len(RUNS)]) + "\n")
        tot = catch_up(spark, log_dir, work, "totals", max_files_per_trigger=1).first()
    assert tot.total_invocations == 20
    from slimctx.streaming.log_stream import _committed, covering
    assert (1, 0) in covering(_committed(spark, os.path.join(work, "totals", "out")), 16)


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns[0] == "entry"
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    llm = {q for q in qs if q.startswith("op") or q == "pipeline"}
    assert set(qs) - set(sql) - llm == set()


def test_rows_without_event_type_are_streamed(spark, tmp_path):
    from pyspark.sql import functions as F

    from slimctx.plans.log_queries import q_log_totals, q_stream_log_totals
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (events.withColumn("event_type", F.when(F.col("event_id") % 10 > 0, F.col("event_type")))
     .write.parquet(str(tmp_path / "events.parquet")))
    got = q_stream_log_totals(spark, str(tmp_path)).first()
    assert got == q_log_totals(spark, str(tmp_path)).first()
    assert got.total_invocations == events.count()
