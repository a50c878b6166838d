import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from slimctx.llm import language_id as L


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 8, 20, 60):
        code = L.codewords(n)
        far = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
        assert min(far) >= (2 ** (n - 2) if n <= 7 else 8)
        assert (np.abs(code.sum(0)) < n).all()
    assert L.codewords(1).shape == (1, 1) and len(L.codewords(0)) == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.op6_query(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out and lang is not null").collect()
    assert len(rows) > 250 and L.op6_query(docs).count() == docs.count()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx"))
                            .otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert sorted(L.op6_query(docs).collect()) == sorted(L.op6_query(wrong).collect())


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", "de")] * 20)]
    return documents(spark, rows)


def test_awkward_rows(spark, toy):
    model = L.fit(toy)
    assert model.langs == ["de", "en", "fr"]
    rows = [(1, None, None), (2, "", None), (3, "12 -- !", None), (4, "the dog", None), (4, "the dog", None),
            (None, "le chien", None), (5, "a", None), (6, "und die " * 300000, None), (7, "漢字", None)]
    got = L.predict(documents(spark, rows), model)
    rows = got.collect()
    assert len(rows) == 9 and "text" not in got.columns
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert [by[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert (by[4].lang_pred, by[None].lang_pred, by[6].lang_pred) == ("en", "fr", "de")
    assert by[5].lang_pred == "de" and by[5].ambiguous
    assert by[7].lang_pred in model.langs
    assert got.select("text_h").columns == ["text_h"]


def test_ambiguous_mixture(spark):
    """Between two languages the scores cross, and only there."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs)
    one, two = (docs.filter((F.col("lang") == g) & (F.length("text") > 1500)).first().text[:1500]
                for g in ("en", "fr"))
    rows = [(i, one[:1500 - 50 * i] + " " + two[:50 * i], None) for i in range(31)]
    got = {r.doc_id: r for r in L.predict(documents(spark, rows), model, 0.9).collect()}
    assert (got[0].lang_pred, got[30].lang_pred) == ("en", "fr")
    assert not got[0].ambiguous and not got[30].ambiguous
    assert any(r.ambiguous for r in got.values())


def test_nothing_or_one_language_to_learn(spark, toy):
    none = L.fit(toy.limit(0))
    assert none.langs == []
    assert {r.lang_pred for r in L.predict(toy, none).collect()} == {"und"}
    one = L.fit(toy.filter("lang = 'fr'"))
    assert {r.lang_pred for r in L.predict(toy, one).collect()} == {"fr"}
    assert L.predict(toy.limit(0), one).count() == 0
    assert L.fit(toy.withColumn("lang", F.lit(None).cast("string"))).langs == []


def test_sample_is_bounded(spark, toy):
    few = L.fit(toy, per_lang=2)
    assert few.langs and set(few.langs) <= {"de", "en", "fr"}


def test_hash_bound_of_a_large_language(spark):
    ids = spark.range(1 << 18)
    for n in (1 << 18, (1 << 23) + 1, 1 << 33, 1 << 45):
        # as if each of the ids stood for n / 2**18 documents
        per_lang = n >> 7
        low = ids.filter(L.low_hash(F.col("id"), F.lit(n).cast("long"), per_lang)).count()
        assert abs(low - 1.5 * (1 << 11)) < 300


def test_blocks_do_not_change_sums(toy, monkeypatch):
    model = L.fit(toy)
    texts = ["der hund " * 50, "", "x", "le chat et " * 9, "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    whole = model.sums(data, off)
    monkeypatch.setattr(L, "BLOCK", 64)
    assert np.allclose(model.sums(data, off), whole)
