"""Benchmark decontamination by winnowing (DataFrame functions only).

A text is its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
A-Z.  Every ``k`` consecutive words are hashed, and each window of
``window`` words is represented by the minimum of its ``window - k + 1``
hashes.  Two equal windows have equal minima, so the join of document and
benchmark minima finds every shared span of ``window`` words or more; the
hits are then extended to whole windows of words, which are compared as text.

A benchmark item of fewer than ``window`` words (but not none) is one window
of its own length, with one hash over all its words.

The benchmark minima are broadcast only up to ``max_broadcast`` rows; beyond
that the minima of the documents, without any text, are shuffled to them and
only the documents that were hit are read again.

Defined results: null and word-free texts have no words and no hits; equal
(doc_id, text) rows give one row; rows with one doc_id and several texts give
one row each; a null doc_id is a value like others; repeated item rows count
once per item_id, a null item_id is listed as ``null``; an empty benchmark hits
nothing; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slimctx.llm.common import ascii_lower, let, sized_broadcast, table
from slimctx.session import materialize

WINDOW = 10
GRAM = 5
MAX_BROADCAST = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def window_minima(hashes: Column, window: int, gram: int) -> Column:
    """The minimum gram hash of every window of words, by window start."""
    grams = F.transform(F.sequence(F.lit(1), F.size(hashes) - gram + 1),
                        lambda i: F.xxhash64(F.slice(hashes, i, gram)))
    minima = grams if gram == window else let(grams, lambda g: F.transform(
        F.sequence(F.lit(1), F.size(g) - (window - gram)),
        lambda i: F.array_min(F.slice(g, i, window - gram + 1))))
    return F.when(F.size(hashes) >= window, minima).otherwise(
        F.array().cast("array<bigint>"))


def _gram(length: int, window: int, gram: int) -> int:
    return gram if length == window else length


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(item, len, m, key): the windows of every benchmark item."""
    ws = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                          text_words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    ws = ws.withColumn("len", F.least(F.size("ws"), F.lit(window)))
    key = ws.select("item", "len", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1),
        lambda i: F.slice("ws", i, F.col("len")))).alias("w"))

    def first(n: int) -> Column:
        return F.get(let(_hashes(F.col("w")),
                         lambda h: window_minima(h, n, _gram(n, window, gram))), F.lit(0))

    m = F.coalesce(*[F.when(F.col("len") == n, first(n)) for n in range(1, window + 1)])
    return key.select("item", "len", m.alias("m"), F.array_join("w", " ").alias("key")).distinct()


def doc_windows(docs: DataFrame, lengths: list[int], window: int, gram: int) -> DataFrame:
    """(doc_id, text_h, ws, w) with one row per window w = (len, s, m), and
    one with len 0 and s = the number of words for each document."""
    def of_length(h: Column, n: int) -> Column:
        return F.transform(window_minima(h, n, _gram(n, window, gram)), lambda m, s: F.struct(
            F.lit(n).alias("len"), s.alias("s"), m.alias("m")))

    def spans(ws: Column) -> Column:
        every = let(_hashes(ws), lambda h: F.concat(*[of_length(h, n) for n in lengths])) \
            if lengths else None
        head = F.array(F.struct(F.lit(0).alias("len"), F.size(ws).alias("s"),
                                F.lit(None).cast("bigint").alias("m")))
        return head if every is None else F.concat(head, every)

    bound = let(text_words(F.col("text")),
                lambda ws: F.struct(ws.alias("ws"), spans(ws).alias("spans")))
    return (docs.select("doc_id", F.xxhash64("text").alias("text_h"), bound.alias("b"))
            .select("doc_id", "text_h", F.col("b.ws").alias("ws"),
                    F.explode("b.spans").alias("w")))


def _candidates(docs: DataFrame, minima: DataFrame, lengths: list[int], window: int, gram: int,
                max_broadcast: int) -> DataFrame:
    """(doc_id, text_h, len, s, key): the windows whose minimum is a benchmark
    minimum, with their text, and the row with len 0 of every document."""
    rows = doc_windows(docs, lengths, window, gram)
    key = F.when(F.col("w.len") > 0,
                 F.array_join(F.slice("ws", F.col("w.s") + 1, F.col("w.len")), " "))
    minima, small = sized_broadcast(minima.withColumn("known", F.lit(True)), max_broadcast)
    if small:
        hit = rows.join(minima, F.col("w.m") == F.col("m"), "left")
        return (hit.filter("w.len = 0 or known")
                .select("doc_id", "text_h", "w.len", "w.s", key.alias("key")))
    slim = rows.select("doc_id", "text_h", "w.len", "w.s", "w.m")
    found = (slim.filter("len > 0").join(minima, "m")
             .groupBy("doc_id", "text_h")
             .agg(F.collect_list(F.struct("len", "s")).alias("found")))
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("text_h")).alias("d")
    both = d.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
                  & (F.col("d.text_h") == F.col("f.text_h")))
    again = (both.select("d.doc_id", "d.text_h", text_words(F.col("text")).alias("ws"), "found")
             .select("doc_id", "text_h", "ws", F.explode("found").alias("w"))
             .select("doc_id", "text_h", "w.len", "w.s", key.alias("key")))
    heads = docs.select("doc_id", F.xxhash64("text").alias("text_h"), F.lit(0).alias("len"),
                        F.size(text_words(F.col("text"))).alias("s"),
                        F.lit(None).cast("string").alias("key"))
    return heads.unionByName(again)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """The report per document and the spans behind it.

    report: doc_id, text_h (hash of the text), n_words, n_hit (words inside an
    occurrence of a benchmark window), n_items, items_sha256, contaminated;
    spans: doc_id, text_h, start, stop in words."""
    items = materialize(item_windows(benchmark, window, gram), "items")
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # <= window
    rows = materialize(_candidates(docs, items.select("m").distinct(), lengths, window, gram,
                                   max_broadcast), "candidates")
    keys, _ = sized_broadcast(items.select("key").distinct(), max_broadcast // 10)
    hits = materialize(rows.filter("len > 0").join(keys, "key").distinct(), "hits")

    doc = ["doc_id", "text_h"]
    by_start = W.partitionBy(*doc).orderBy("s")
    before = by_start.rowsBetween(W.unboundedPreceding, -1)
    stop = F.col("s") + F.col("len")
    longest = hits.groupBy(*doc, "s").agg(F.max("len").alias("len"))
    covered = longest.withColumn("reach", F.coalesce(F.max(stop).over(before), F.lit(0)))
    n_hit = covered.groupBy(*doc).agg(F.sum(F.greatest(
        F.lit(0), stop - F.greatest("s", "reach"))).alias("n_hit"))
    owned = hits.select(*doc, "key").distinct().join(items.select("key", "item"), "key")
    n_items = (owned.select(*doc, "item").distinct()
               .groupBy(*doc).agg(F.sort_array(F.collect_list("item")).alias("items")))

    none = F.lit(None)
    parts = (rows.filter("len = 0")
             .select(*doc, F.col("s").alias("n_words"), none.cast("long").alias("n_hit"),
                     none.cast("array<string>").alias("items"))
             .unionByName(n_hit.withColumn("n_words", none.cast("int")).withColumn(
                 "items", none.cast("array<string>")))
             .unionByName(n_items.withColumn("n_words", none.cast("int")).withColumn(
                 "n_hit", none.cast("long"))))
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    report = (parts.groupBy(*doc)
              .agg(F.max("n_words").cast("long").alias("n_words"),
                   F.coalesce(F.max("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
                   F.max("items").alias("items"))
              .select(*doc, "n_words", "n_hit", F.size(items_of).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items_of, ",").cast("binary"), 256)
                      .alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))

    island = F.sum((F.col("s") > F.col("reach")).cast("int")).over(by_start)
    spans = (covered.withColumn("island", island).groupBy(*doc, "island")
             .agg(F.min("s").alias("start"), F.max(stop).alias("stop"))
             .select(*doc, "start", "stop"))
    return report, spans


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, by winnowing."""
    report, _ = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                              table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return report.drop("text_h")


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark
), il AS (
  SELECT item_id, ws, least(len(ws), 10) AS n FROM bw WHERE len(ws) > 0
), ik AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i + 1 : i + n], ' ') AS key
  FROM (SELECT item_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM il)
), dk AS (
  SELECT doc_id, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS key
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i
        FROM dw, (SELECT DISTINCT n FROM il) WHERE len(ws) >= n)
), hits AS (
  SELECT DISTINCT doc_id, i, n, item_id FROM dk JOIN ik USING (n, key)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items,
         string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON dw.doc_id = words.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id
"""
