"""Quality rules, judged per document and per host.

Every document is measured once.  Two rules decide on the document alone
(``base_failed``): fewer than ``MIN_WORDS`` words, or more than
``REPEAT_PERCENT`` per cent of its words in repeated 3-word windows.  Three
softer rules (symbols per word, repeated lines, mean word length) do not
reject by themselves: a host's share of documents that fail any rule is
shrunk towards the share of all hosts, and a host whose shrunk share passes
``HOST_LIMIT`` loses its documents.

**Empirical beta prior.**  Hosts' failures are taken as binomial draws with
beta-distributed rates.  With ``m`` the rate of all documents of all hosts and
``s2`` the excess of the hosts' spread over the binomial one (method of
moments), the prior is ``beta(m k, (1 - m) k)`` with ``k = m (1 - m) / s2 - 1``
and a host's rate is ``(failed + m k) / (n + k)``.  A host of few documents
thus stays near ``m``, a host of many is judged by its own.  Without an excess
(one host, or hosts that are alike) all rates are ``m``.

Failures are summed before they are shuffled, so a hot host is a few partial
sums.  The host table goes back to the documents by ``join_unique``: hosts
over a thousandth of all documents are fewer than a thousand and are
broadcast, the others go through the shuffle; texts are not joined, only
measures.

Defined results: a null text has no words and fails; documents without host
(null) belong to none and are judged alone; repeated rows count and are
returned one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimctx.llm.common import arrow_batches, join_unique
from slimctx.session import materialize

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: The softer rules: symbols per 100 words, repeated lines per 100 words, and
#: the mean word length in characters (low and high, each in tenths).
SYMBOL_PERCENT = 10
LINE_PERCENT = 5
WORD_TENTHS = (20, 150)
#: A host goes when more than this share of its documents fails, as shrunk.
HOST_LIMIT = 0.5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], size: int = 3) -> int:
    """The number of words in windows of ``size`` words found twice or more."""
    if len(words) <= size:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # windows are numbered step by step, so numbers never exceed the words
    window = ids
    for k in range(1, size):
        pair = window[:-1] * len(words) + ids[k:]
        window = np.unique(pair, return_inverse=True)[1]
    often = np.flatnonzero(np.bincount(window)[window] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + size, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a text."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)),
            len(lines) - len(set(lines)), repeated_words(words))


def measures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, host, text)`` with the MEASURES in the place of the text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(t.as_py()) for t in batch.column("text")],
                             np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"),
                 *[pa.array(found[:, i].copy()) for i in range(len(MEASURES))]],
                names=["doc_id", "host", *MEASURES])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("host").cast("string").alias("host"), "text")
            .mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES)))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))


def rule_failed() -> Column:
    """Any rule, the softer ones included."""
    n, low, high = F.col("n_words"), *WORD_TENTHS
    return (base_failed() | (F.col("n_symbols") * 100 > n * SYMBOL_PERCENT)
            | (F.col("n_dup_lines") * 100 > n * LINE_PERCENT)
            | (F.col("word_chars") * 10 < n * low) | (F.col("word_chars") * 10 > n * high))


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """``hosts(host, host_docs, host_failed)`` with ``host_rate``, the rate
    shrunk by the beta prior of all hosts (one row of sums)."""
    n, x = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    sums = hosts.agg(F.sum("host_docs").cast("double").alias("n"), F.sum("host_failed").cast("double").alias("x"),
                     F.sum(n * n).alias("nn"), F.sum(x * x / n).alias("xx"),
                     F.count("*").alias("hosts")).first()
    m, k = 0.0, None
    if sums["n"]:
        m = sums["x"] / sums["n"]
        # within and between hosts: E[sum n (p - m)^2] = (hosts - 1) m (1 - m)
        # (1 - rho) + rho m (1 - m) (n - nn / n), with rho = 1 / (k + 1)
        spread = sums["xx"] - sums["n"] * m * m
        plain = m * (1 - m) * (sums["hosts"] - 1)
        room = m * (1 - m) * (sums["n"] - sums["nn"] / sums["n"] - (sums["hosts"] - 1))
        if room > 0 and spread > plain:
            rho = min((spread - plain) / room, 1.0)
            k = 1 / rho - 1
    rate = F.lit(m) if k is None else (x + m * k) / (n + k)
    return hosts.withColumn("host_rate", rate)


def host_rules(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """``docs(doc_id, host, text)`` to (doc_id, host, MEASURES, base_failed,
    rule_failed, host_docs, host_failed, host_rate, kept)."""
    rows = materialize(measures(docs).withColumn("base_failed", base_failed())
                       .withColumn("rule_failed", rule_failed()), "measures")
    hosts = materialize(rows.filter("host is not null").groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("rule_failed").cast("long")).alias("host_failed")), "hosts")
    judged = shrunk_rates(hosts)
    total = rows.count()
    own = [F.lit(None).cast(t).alias(c) for c, t in
           (("host_docs", "long"), ("host_failed", "long"), ("host_rate", "double"))]
    joined = join_unique(rows.filter("host is not null"), judged, ["host"], "host_docs", total)
    alone = rows.filter("host is null").select("*", *own)
    fine = F.coalesce(F.col("host_rate") <= host_limit, F.lit(True))
    return joined.unionByName(alone).withColumn("kept", ~F.col("base_failed") & fine)


def op13_query(docs: DataFrame) -> DataFrame:
    """The documents' sources are the hosts."""
    return host_rules(docs.select("doc_id", F.col("source").alias("host"), "text")).select(
        "doc_id", *MEASURES, "base_failed", "kept", "rule_failed", "host_docs", "host_failed")


OP13_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT rid, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), r AS (
  SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 5 * n_words
         OR 10 * word_chars < 20 * n_words OR 10 * word_chars > 150 * n_words AS rule_failed FROM f
), h AS (
  SELECT host, count(*) AS host_docs, CAST(sum(rule_failed::INT) AS BIGINT) AS host_failed
  FROM r WHERE host IS NOT NULL GROUP BY host
), s AS (
  SELECT sum(host_failed) / sum(host_docs) AS m, CAST(sum(host_docs) AS DOUBLE) AS n,
         sum(host_docs * host_docs) / sum(host_docs) AS nn, count(*) - 1.0::DOUBLE AS hosts,
         sum(host_failed * host_failed / host_docs) AS xx FROM h
), rho AS (
  SELECT m, CASE WHEN m * (1 - m) * (n - nn - hosts) > 0 AND xx - n * m * m > m * (1 - m) * hosts
    THEN least((xx - n * m * m - m * (1 - m) * hosts) / (m * (1 - m) * (n - nn - hosts)), 1) END AS rho FROM s
), v AS (
  SELECT host, host_docs, host_failed, CASE WHEN rho IS NULL THEN m
    ELSE (host_failed + m * (1 / rho - 1)) / (host_docs + 1 / rho - 1) END AS rate FROM h, rho
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(rate <= 0.5, true) AS kept, rule_failed, host_docs, host_failed
FROM r LEFT JOIN v USING (host)
"""
