"""The corpus pipeline: five stages over ``documents``, each one written as
Parquet and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the columns of documents, the last one the encoded documents.

1. language_id: documents whose language cannot be told (no text, no letter)
   go.  The classifiers learn from the documents given; which language they
   tell, its score and the ambiguous flag reject nothing, and without a label
   to learn from only texts without a letter go as well.
2. line_dedup: repeated lines go from the texts; ``n_chars`` follows.
3. jaccard_join: of each group of near copies the document of the smallest
   doc_id stays (without any id: that of the smallest text hash).
4. decontaminate: documents that hold a benchmark passage go.
5. sentencepiece: what is left is encoded, with sampled segmentations.

Rows that agree in doc_id and text are one document: they stay or go together.
Unknown columns are carried along by all stages but the last; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.llm import (decontaminate, jaccard_join, language_id, line_dedup,
                         sentencepiece_sample)
from slimctx.llm.common import sized_broadcast, table
from slimctx.session import apply_defaults, materialize


MAX_BROADCAST = 2_000_000


def _packed(docs: DataFrame) -> DataFrame:
    """(all, doc_id, text): whole rows beside what the operators read, so that
    no column of the documents can clash with one of theirs."""
    return docs.select(F.struct(*docs.columns).alias("all"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the one column of
    ``gone``, which is broadcast while it is small: then no text is shuffled."""
    gone, _ = sized_broadcast(materialize(gone.toDF("gone"), "gone"), MAX_BROADCAST)
    return (_packed(docs).withColumn("key", key)
            .join(gone, F.col("key") == F.col("gone"), "left_anti").select("all.*"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:     # nothing to tell languages by: all of them are unknown
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = language_id.predict(_packed(docs).select("all", "text"), model)
    return told.filter(F.col("lang_pred") != language_id.UNKNOWN).select("all.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    cut = line_dedup.line_dedup(_packed(docs))
    gone = F.col("n_dropped") > 0
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[
        F.when(gone, changed[c]).otherwise(F.col("all")[c]).alias(c) if c in changed
        else F.col("all")[c].alias(c) for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    rows = materialize(jaccard_join.jaccard_join(docs.select("doc_id", "text")), "components")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    first = rows.groupBy("root").agg(least.alias("first")).select("first.rid")
    gone = rows.join(first, "rid", "left_anti").select("rid")
    return _without(docs, gone, F.xxhash64("doc_id", "text"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    report, _ = decontaminate.decontaminate(
        docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    gone = report.filter("contaminated").select(F.xxhash64("doc_id", "text_h"))
    return _without(docs, gone, F.xxhash64("doc_id", F.xxhash64("text")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return sentencepiece_sample.encode(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_copy_stage),
    ("decontaminate", benchmark_stage),
    ("sentencepiece", encode_stage),
]

#: The first and the last stage (classifiers, sampling) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    name, stage = STAGES[-1]
    return materialize(stage(spark, docs, sf_dir), f"stage-{name}")
