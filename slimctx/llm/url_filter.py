"""URL filters by a temporal list join (DataFrame functions only).

A list is a history of dated changes (list_id, pattern, action, at): ``block``
or ``allow`` puts a pattern on the list, ``remove`` takes it off.  The changes
of one pattern become validity intervals [valid_from, valid_to), and every
capture is evaluated against the intervals that hold at its fetch time.

Patterns are a domain (``example.com``: the host and all hosts below it) or a
host with a path prefix (``a.example.com/x/y``, at segment borders).  The
capture lists all patterns that could match it, so the as-of join is an
equi-join on pattern and time bucket with the interval as a residual
condition; intervals are cut at bucket borders within the time span of the
captures.  The list is broadcast up to ``max_broadcast`` intervals, beyond
that it is shuffled and adaptive execution splits the captures of hot patterns.

Of the entries that hold, the longest pattern decides; of equal patterns
``allow`` goes before ``block``, then the smallest list_id, then the earliest
start.

Defined results: a null url or one without host, and a null fetch time, match
nothing (verdict ``none``); equal capture rows (page_id, url, fetched) give one
row; changes of one list and pattern at the same instant: ``remove``, then
``block``, then ``allow`` is the last that counts; changes with a null in any
column, repeated changes and an empty list change nothing; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slimctx.llm.common import ascii_lower, let, sized_broadcast
from slimctx.session import materialize

BUCKET = 30 * 86_400
MAX_BROADCAST = 200_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
CAPTURE = ["page_id", "url", "fetched"]


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def url_patterns(url: Column) -> Column:
    """Every pattern that matches the url."""
    segments = F.array_remove(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"),
                              "")

    def of(host: Column) -> Column:
        domains = let(F.split(host, r"\."), lambda ls: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(ls) - 1, F.lit(1))),
            lambda i: F.array_join(F.slice(ls, i, F.size(ls)), ".")))
        paths = let(segments, lambda ss: F.when(F.size(ss) > 0, F.transform(
            F.sequence(F.lit(1), F.size(ss)),
            lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(ss, F.lit(1), i), "/"))))
            .otherwise(F.array().cast("array<string>")))
        return F.when(host != "", F.concat(domains, paths)).otherwise(
            F.array().cast("array<string>"))

    return let(url_host(url), of)


def validity(changes: DataFrame) -> DataFrame:
    """(list_id, pattern, action, valid_from, valid_to): when entries hold."""
    rank = F.array_position(F.array(*map(F.lit, ("remove", "block", "allow"))), F.col("action"))
    last = (changes.select("list_id", "pattern", "action", "at").dropna()
            .groupBy("list_id", "pattern", "at")
            .agg(F.max_by("action", rank).alias("action")))
    order = W.partitionBy("list_id", "pattern").orderBy("at")
    return (last.withColumn("valid_to", F.lead("at").over(order))
            .filter(F.col("action") != "remove")
            .select("list_id", "pattern", "action", F.col("at").alias("valid_from"), "valid_to"))


def url_filter(captures: DataFrame, changes: DataFrame, bucket: int = BUCKET,
               max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(page_id, url, fetched, n_active, verdict, list_id, pattern, valid_from,
    valid_to) per capture (page_id, url, fetched); times are epoch seconds."""
    span = captures.agg(F.min("fetched").alias("a"), F.max("fetched").alias("b")).first()
    first, last = ((span["a"] or 0) // bucket, (span["b"] or 0) // bucket)
    cut = F.sequence(
        F.greatest(F.floor(F.col("valid_from") / bucket), F.lit(first)),
        F.least(F.floor((F.coalesce("valid_to", F.lit((last + 1) * bucket)) - 1) / bucket),
                F.lit(last)))
    pieces = materialize(
        validity(changes)
        .filter((F.col("valid_from") < (last + 1) * bucket)
                & (F.coalesce(F.col("valid_to"), F.lit((last + 1) * bucket)) > first * bucket))
        .withColumn("bucket", F.explode(cut)), "intervals")
    pieces, _ = sized_broadcast(pieces, max_broadcast)
    wanted = (captures.select(*CAPTURE).distinct()
              .select(*CAPTURE, F.posexplode_outer(url_patterns(F.col("url")))
                              .alias("nth", "pattern"))
              .withColumn("bucket", F.floor(F.col("fetched") / bucket)))
    c, e = wanted.alias("c"), pieces.alias("e")
    holds = ((F.col("c.pattern") == F.col("e.pattern")) & (F.col("c.bucket") == F.col("e.bucket"))
             & (F.col("valid_from") <= F.col("fetched"))
             & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    found = c.join(e, holds, "left").filter("list_id is not null or coalesce(nth, 0) = 0")
    rank = F.struct(-F.length("e.pattern"), F.col("action"), F.col("list_id"), F.col("valid_from"))
    entry = F.when(F.col("list_id").isNotNull(),
                   F.struct(F.col("list_id"), F.col("e.pattern").alias("pattern"),
                            F.col("action"), F.col("valid_from"), F.col("valid_to")))
    return (found.groupBy(*[F.col(f"c.{x}") for x in CAPTURE])
            .agg(F.count("list_id").alias("n_active"),
                 F.min_by(entry, F.when(F.col("list_id").isNotNull(), rank)).alias("best"))
            .select(*CAPTURE, "n_active",
                    F.coalesce("best.action", F.lit("none")).alias("verdict"), "best.list_id",
                    "best.pattern", "best.valid_from", "best.valid_to"))


# ---- the query: captures and list histories derived from the page table ----

EPOCH, DAY = 1_704_067_200, 86_400


def _number(c: Column) -> Column:
    """24 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 6), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    n = _number(F.col("page_id").cast("string"))
    return pages.select("page_id", "url", (F.lit(EPOCH) + (n % 365) * DAY + n % DAY)
                        .alias("fetched"))


def derived_changes(pages: DataFrame) -> DataFrame:
    """A history of three changes for every domain and host of the pages and
    for every tenth path: listed, taken off, listed again."""
    n = F.col("n")
    listed = (pages.select(F.explode(url_patterns(F.col("url"))).alias("pattern")).distinct()
              .withColumn("n", _number(F.col("pattern")))
              .filter(~F.contains("pattern", F.lit("/")) | (n % 10 == 0)))
    action = F.when(n % 3 == 0, "allow").otherwise("block")
    begin = F.lit(EPOCH) + (n % 200) * DAY
    off = begin + (30 + n % 50) * DAY
    change = [F.struct(begin.alias("at"), action.alias("action")),
              F.struct(off.alias("at"), F.lit("remove").alias("action")),
              F.struct((off + 40 * DAY).alias("at"), action.alias("action"))]
    return (listed.select(F.concat(F.lit("list"), (n % 5).cast("string")).alias("list_id"),
                          "pattern", F.explode(F.array(*change)).alias("c"))
            .select("list_id", "pattern", "c.action", "c.at"))


def op4_query(pages: DataFrame) -> DataFrame:
    """Every page against the list entries active when it was fetched."""
    pages = pages.select("page_id", "url")
    return url_filter(derived_captures(pages), derived_changes(pages)).drop("url")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6))::BIGINT AS n,
         translate(regexp_extract(coalesce(url, ''),
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''),
           '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS ss
  FROM pages
), cap AS (
  SELECT page_id, url, 1704067200 + (n % 365) * 86400 + n % 86400 AS fetched, host, ss,
         string_split(host, '.') AS ls FROM p
), pat AS (
  SELECT page_id, url, fetched, unnest(list_concat(
    list_transform(range(1, greatest(len(ls) - 1, 1) + 1),
                   lambda i: array_to_string(ls[i:], '.')),
    list_transform(range(1, len(ss) + 1),
                   lambda i: host || '/' || array_to_string(ss[1:i], '/')))) AS pattern
  FROM cap WHERE host <> ''
), listed AS (
  SELECT pattern, n FROM (
    SELECT DISTINCT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS n FROM pat)
  WHERE NOT contains(pattern, '/') OR n % 10 = 0
), entry AS (
  SELECT 'list' || (n % 5) AS list_id, pattern,
         CASE WHEN n % 3 = 0 THEN 'allow' ELSE 'block' END AS action,
         1704067200 + (n % 200) * 86400 AS begin_at, (30 + n % 50) * 86400 AS stay FROM listed
), iv AS (
  SELECT list_id, pattern, action, begin_at AS valid_from, begin_at + stay AS valid_to FROM entry
  UNION ALL
  SELECT list_id, pattern, action, begin_at + stay + 40 * 86400, NULL FROM entry
), hit AS (
  SELECT pat.page_id, pat.url, pat.fetched, iv.* FROM pat JOIN iv USING (pattern)
  WHERE valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)
), best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id, url, fetched) AS n_active,
         row_number() OVER (PARTITION BY page_id, url, fetched
           ORDER BY length(pattern) DESC, action, list_id, valid_from) AS r FROM hit
)
SELECT DISTINCT cap.page_id, cap.fetched, coalesce(n_active, 0) AS n_active,
       coalesce(action, 'none') AS verdict, list_id, pattern, valid_from, valid_to
FROM cap LEFT JOIN best ON cap.page_id = best.page_id AND cap.url = best.url AND r = 1
"""
