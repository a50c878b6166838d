import corpus_pipeline as P
from helpers import documents

from slimctx.llm import decontaminate, jaccard_join, line_dedup


def test_stages_on_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, at = docs.columns, docs
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        before, at = at, P.materialize(stage(spark, at, d), name)
        assert at.columns == columns and at.schema == docs.schema
        ids = {r.doc_id for r in at.collect()}
        was = {r.doc_id: r for r in before.collect()}
        if name == "language_id":
            assert ids == {i for i, r in was.items() if r.text and any(c.isalpha() for c in r.text)}
        elif name == "line_dedup":
            want = {r.doc_id: r.kept for r in line_dedup.line_dedup(before).collect()}
            assert {r.doc_id: r.text for r in at.collect()} == want
            assert all(len(r.text) == r.n_chars for r in at.collect())
        elif name == "jaccard_join":
            want = jaccard_join.op7_query(before).collect()
            assert ids == {r.component_id for r in want}
        else:
            report, _ = decontaminate.decontaminate(before, bench)
            assert ids == {r.doc_id for r in report.collect() if not r.n_hit}
    last = P.STAGES[-1][1](spark, at, d).collect()
    assert {r.doc_id for r in last} == ids and all(r.exact for r in last)
    run = P.run(spark, d)
    assert sorted((r.doc_id, r.rank) for r in run.collect()) == sorted((r.doc_id, r.rank) for r in last)


def test_awkward_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(1, None, "en"), (2, "", "en"), (3, "--- 12", None), (4, "same text of words here now", "en"),
            (4, "same text of words here now", "en"), (5, "same text of words here now", "fr"),
            (None, "no id but words", "en"), (6, "word " * 30000, None)]
    at = documents(spark, rows)
    for name, stage in P.STAGES[:-1]:
        at = P.materialize(stage(spark, at, d), name)
    assert {r.doc_id for r in at.collect()} == {4, 6, None}
    assert P.STAGES[-1][1](spark, at, d).filter("not exact").count() == 0
    at = documents(spark, rows).limit(0)
    for name, stage in P.STAGES:
        at = P.materialize(stage(spark, at, d), name)
    assert at.count() == 0


def test_near_copies_without_id_and_several_texts_of_one_id(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    near = {c: t + " more" for c, t in text.items()}
    rows = [(None, text["a"], "en"), (None, text["b"], "en"), (None, near["b"], "en"),
            (4, text["c"], "en"), (4, text["d"], "en"), (9, near["d"], "en"),
            (None, near["e"], "en"), (7, text["e"], "en"), (8, text["f"], "en"),
            (8, near["f"], "en"), (5, text["g"], "en"), (5, text["g"], "en"),
            (6, "", "en"), (None, "", "en")]
    kept = [(r.doc_id, r.text) for r in
            P.near_copy_stage(spark, documents(spark, rows), None).collect()]
    either = [{(None, text["b"]), (None, near["b"])}, {(8, text["f"]), (8, near["f"])}]
    assert all(len(e & set(kept)) == 1 for e in either)
    rest = [r for r in kept if not any(r in e for e in either)]
    assert sorted(rest, key=str) == sorted(
        [(None, text["a"]), (4, text["c"]), (4, text["d"]), (7, text["e"]), (5, text["g"]),
         (5, text["g"]), (6, ""), (None, "")], key=str)


def test_language_stage_without_labels_or_ids(spark):
    rows = [(1, "some words", "en"), (2, "d'autres mots", None), (3, "--- 12", "en"),
            (4, None, "en"), (5, "", None), (6, "漢字", "fr")]
    no_lang = documents(spark, [(i, t, None) for i, t, _ in rows])
    no_id = documents(spark, [(None, t, g) for _, t, g in rows])
    for docs in (no_lang, no_id):
        got = P.language_stage(spark, docs, None)
        assert got.columns == docs.columns
        assert {r.text for r in got.collect()} == {"some words", "d'autres mots", "漢字"}
