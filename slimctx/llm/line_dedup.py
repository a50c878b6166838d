"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

Every batch of documents becomes one *run*: a table of (line digest, number
of documents, largest doc_id), sorted by digest.  Runs of one level are
merged into one run of the next level as soon as ``fanout`` of them exist, so
a corpus fed in n batches is rewritten log_fanout(n) times.

Two uses:

* ``line_dedup`` (whole table): a line goes when its key has at least
  ``min_chars`` code points and is held by at least ``min_docs`` documents,
  except in the largest doc_id that holds it; the runs count, then the lines
  are joined plainly with the common digests;
* ``LineRuns.fresh`` (stream of batches): keeps of a new batch the lines no
  earlier run holds, by a merge anti-join, then adds the batch as a run of its
  own.

Defined results: null or empty text is one empty line; a line key is the line
without blanks ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case;
rows with the same doc_id count as one document, and each of them is returned;
rows without doc_id are returned whole and count for no line; all lines of
the keeping document stay; other input columns are carried unchanged, also
ones named like the working columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.llm.common import ascii_lower, digest128, join_unique, let
from slimctx.session import materialize

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 4
BLANKS = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_entries(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_h, pos, h1, h2) of every line long enough to be compared."""
    key = line_key(F.col("line"))
    h1, h2 = digest128(F.col("key"))
    return (docs.filter("doc_id is not null")
            .select("doc_id", F.xxhash64("text").alias("text_h"),
                    F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
            .filter(F.length("line") >= min_chars)
            .select("doc_id", "text_h", "pos", key.alias("key"))
            .filter(F.length("key") >= min_chars)
            .select("doc_id", "text_h", "pos", h1.alias("h1"), h2.alias("h2")))


class LineRuns:
    """Levelled runs of (h1, h2, n_docs, n_rows, top_doc), sorted by digest."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def add(self, entries: DataFrame) -> None:
        """Add the run of a batch; no document may be split over two batches."""
        run = (entries.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
               .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_rows"),
                                        F.max("doc_id").alias("top_doc")))
        self._push(run, 0)

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(run, level))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(self._merged(full), level + 1)

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        return materialize(run.sortWithinPartitions("h1", "h2"), f"run-l{level}")

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return (reduce(DataFrame.unionByName, runs).groupBy("h1", "h2")
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_rows").alias("n_rows"),
                     F.max("top_doc").alias("top_doc")))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def merged(self) -> DataFrame | None:
        """One row per digest over all runs."""
        runs = self.runs()
        if not runs:
            return None
        return runs[0] if len(runs) == 1 else self._merged(runs)

    def fresh(self, entries: DataFrame) -> DataFrame:
        """The entries of a new batch that no run holds; the batch is added.

        A digest that occurs more than once within the batch stays in its
        smallest (doc_id, pos)."""
        entries = materialize(entries, "batch")
        known = self.merged()
        out = entries
        if known is not None:
            out = out.join(known.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        first = out.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
        out = materialize(first.select("at.doc_id", "at.pos", "h1", "h2"), "fresh")
        self.add(entries)
        return out


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                  batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, text_h, drop): the positions of the lines that go, per document."""
    spark = docs.sparkSession
    entries = materialize(line_entries(docs.select("doc_id", "text"), min_chars)
                          .withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))
                                      .cast("int")), "lines")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(entries.filter(F.col("batch") == b))
    common = materialize(runs.merged().filter(F.col("n_docs") >= min_docs), "common")
    hits = join_unique(entries, common, ["h1", "h2"], "n_rows", entries.count())
    return (hits.filter("doc_id < top_doc")
            .groupBy("doc_id", "text_h").agg(F.collect_set("pos").alias("drop")))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with (n_lines, n_dropped, kept) added: the text without the
    repeated lines.  A line position is gathered only within its document."""
    drop = dropped_lines(docs, min_chars, min_docs, batches, fanout)
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"),
                    F.xxhash64("text").alias("_th"))
    d = d.join(drop.toDF("_id", "_th", "_drop"), ["_id", "_th"], "left")
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    n_lines = F.size(text_lines(F.col("_row.text")))
    kept = let(text_lines(F.col("_row.text")), lambda ls: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drop")),
                    lambda i: F.get(ls, i)), "\n"))
    own = [F.col("_row")[c].alias(c) for c in docs.columns
           if c not in ("n_lines", "n_dropped", "kept")]
    return d.select(*own, n_lines.cast("long").alias("n_lines"),
                    F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("_drop").isNull(), text).otherwise(kept).alias("kept"))


def op8_query(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped",
                                   F.sha2(F.col("kept").cast("binary"), 256)
                                   .alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), common AS (
  SELECT key, max(doc_id) AS top_doc FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.top_doc, false) AS gone
  FROM k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM m GROUP BY doc_id
"""
