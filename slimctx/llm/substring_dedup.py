"""Substring dedup by hashing units of lines.

A line is cut into units at words that are local minima of their hash within
``radius`` words on either side (a short line is one unit), so a passage that
sits in the middle of different lines is cut alike in each of them.  Units are
normalised to their words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower
case and hashed; digests are grouped over the whole corpus, and every
occurrence but the earliest ranked one (smallest doc_id, then text hash, then
position) is a repeat.  Runs of consecutive repeats that cover at least
``min_chars`` characters are removed, reported with their original offsets.

Whole lines are units as well, of any length: every occurrence of a normalised
line but the earliest is removed, also where no run covers it.  Equal lines are
cut alike, so a line can only recur where its first unit does; the digests of
lines are grouped among those.  ``whole_lines=False`` leaves the passages alone.

A digest that very many units share is joined by a bounded broadcast; units
are counted before they are shuffled, and nothing but the units of one
document is ever ordered together.

Defined results: null, empty and word-free texts have no units; rows equal in
doc_id and text are one document; several texts of one doc_id are separate
documents; rows without doc_id are left alone; other columns are ignored.
Offsets are code points of the original text, [start, stop).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slimctx.llm.common import arrow_batches, join_unique, text_buffers
from slimctx.llm.textvec import blocks, byte_values, lower_ascii, segment_hashes, words
from slimctx.session import materialize

RADIUS = 3
MIN_CHARS = 120
BLOCK = 1 << 20
UNIT_SCHEMA = "digest long, doc_id long, place long, span long, line long, extent long"

#: Bytes outside of words: all ASCII but letters and digits.
NOT_WORD = np.ones(256, bool)
NOT_WORD[128:] = False
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = False


def _cuts(h: np.ndarray, line: np.ndarray, radius: int) -> np.ndarray:
    """Whether a unit ends with each word: local minima, and ends of lines."""
    cut = np.ones(len(h), bool)
    for k in range(1, radius + 1):
        same = line[k:] == line[:-k]
        cut[k:] &= ~same | (h[k:] < h[:-k])
        cut[:-k] &= ~same | (h[:-k] <= h[k:])
    cut[-1:] = True
    cut[:-1] |= line[1:] != line[:-1]
    return cut


def units(data: np.ndarray, off: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, ...]:
    """(doc, number in doc, digest, start, stop) of every unit; offsets in
    code points of its text."""
    return units_and_lines(data, off, radius)[:5]


def units_and_lines(data: np.ndarray, off: np.ndarray,
                    radius: int = RADIUS) -> tuple[np.ndarray, ...]:
    """``units``, and of every line with words (its first unit, number of
    units, digest, stop)."""
    start, stop, doc = words(data, off, NOT_WORD)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none.astype(np.uint64), none, none, none, none, \
            none.astype(np.uint64), none
    values = byte_values(lower_ascii())[data]
    h = segment_hashes(values, start, stop)
    breaks = np.cumsum(data == 10)
    line = breaks[start] + doc * (int(breaks[-1]) + 1)
    last = np.flatnonzero(_cuts(h, line, radius))
    first = np.r_[0, last[:-1] + 1]
    digest = segment_hashes(h, first, last + 1)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    udoc = doc[first]
    base = chars[off[udoc]]
    number = np.arange(len(first)) - np.searchsorted(udoc, udoc, "left")
    a, b = chars[start[first]] - base, chars[stop[last]] - base
    uline = line[first]
    head = np.flatnonzero(np.r_[True, uline[1:] != uline[:-1]])
    tail = np.r_[head[1:], len(uline)] - 1
    whole = segment_hashes(h, first[head], last[tail] + 1)
    return udoc, number, digest, a, b, head, tail + 1 - head, whole, b[tail]


def _unit_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column("text"))
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)
            text_h = batch.column("text_h").to_numpy(zero_copy_only=False)
            for i, j in blocks(off, BLOCK):
                doc, number, digest, a, b, head, many, whole, end = units_and_lines(
                    data[off[i]:off[j]], off[i:j + 1] - off[i], radius)
                place = (text_h[i:j][doc] << 32) | number
                # the first unit of a line carries the line
                inner = np.ones(len(doc), bool)
                inner[head] = False
                line, extent = np.zeros((2, len(doc)), np.int64)
                line[head], extent[head] = whole.view(np.int64), (many << 32) | end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest.view(np.int64)), pa.array(doc_id[i:j][doc], pa.int64()),
                     pa.array(place, pa.int64()), pa.array((a << 32) | b, pa.int64()),
                     pa.array(line, pa.int64(), mask=inner),
                     pa.array(extent, pa.int64(), mask=inner)],
                    names=["digest", "doc_id", "place", "span", "line", "extent"])
    return run


def _line_repeats(met: DataFrame) -> DataFrame:
    """(doc_id, place, span, first_doc, n_units) of every line but the
    earliest of its digest, from the shared units that begin lines."""
    lines = met.filter("line is not null").select("line", "doc_id", "place", "span", "extent")
    first = (lines.groupBy("line").agg(F.min(F.struct("doc_id", "place")).alias("first"),
                                       F.count("*").alias("n")).filter("n > 1"))
    start = F.shiftright("span", 32)
    stop = F.col("extent").bitwiseAND(F.lit(0xFFFFFFFF))
    return (join_unique(lines, first, ["line"], "n", lines.count())
            .filter(F.struct("doc_id", "place") > F.col("first"))
            .select("doc_id", "place", F.shiftleft(start, 32).bitwiseOR(stop).alias("span"),
                    F.col("first.doc_id").alias("first_doc"),
                    F.shiftright("extent", 32).alias("n_units"))
            .dropDuplicates(["doc_id", "place"]))


def repeats(docs: DataFrame, radius: int = RADIUS, min_chars: int = MIN_CHARS,
            whole_lines: bool = False) -> DataFrame:
    """(doc_id, text_h, start, stop, n_units, kept_doc_id): the passages to
    remove, and the document that holds the first occurrence of their first
    unit.  With ``whole_lines`` also every repeated line that is in no such
    passage, and the document that holds the line first."""
    arrow_batches(docs.sparkSession)
    low32 = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))
    every = materialize(
        docs.filter("doc_id is not null and text is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), low32.alias("text_h"), "text")
        .mapInArrow(_unit_rows(radius), UNIT_SCHEMA), "units")
    shared = (every.groupBy("digest").agg(F.min("doc_id").alias("first_doc"),
                                          F.count("*").alias("n")).filter("n > 1"))
    met = materialize(join_unique(every, shared, ["digest"], "n", every.count())
                      .select("digest", "doc_id", "place", "span", "first_doc", "line", "extent"),
                      "shared-units")
    keeper = (met.filter("doc_id = first_doc").groupBy("digest")
              .agg(F.min("place").alias("first_place"), F.count("*").alias("n")))
    home = join_unique(met.filter("doc_id = first_doc"), keeper, ["digest"], "n",
                       met.filter("doc_id = first_doc").count())
    again = (met.filter("doc_id > first_doc")
             .unionByName(home.filter("place > first_place").select(*met.columns))
             .select("doc_id", "place", "span", "first_doc")
             .dropDuplicates(["doc_id", "place"]).withColumn("n_units", F.lit(None).cast("long")))
    if whole_lines:
        again = again.unionByName(_line_repeats(met))
    again = again.select(
        "doc_id", F.shiftright("place", 32).alias("text_h"),
        F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("unit"),
        F.shiftright("span", 32).alias("start"),
        F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).alias("stop"), "first_doc", "n_units")
    # a unit (n_units null) comes before the line that it begins
    unit = F.col("n_units").isNull()
    in_doc = (W.partitionBy("doc_id", "text_h").orderBy("unit", F.col("n_units").isNotNull())
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    span = [F.col(c) for c in ("start", "stop", "n_units")] + [F.col("first_doc")
                                                               .alias("kept_doc_id")]
    runs = (again.withColumn("run", F.col("unit") - F.count(F.when(unit, 1)).over(in_doc))
            .groupBy("doc_id", "text_h", "run")
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
                 F.count(F.when(unit, 1)).alias("n_units"),
                 F.min_by("first_doc", F.when(unit, F.col("unit"))).alias("first_doc"),
                 F.collect_list(F.when(~unit, F.struct(*span))).alias("lines")))
    passage = F.col("stop") - F.col("start") >= min_chars
    return (runs.select("doc_id", "text_h", F.explode(
        F.when(passage, F.array(F.struct(*span))).otherwise(F.col("lines"))).alias("s"))
        .select("doc_id", "text_h", "s.*"))


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with text cut to what stays and ``kept`` (added, or in place of
    a column of that name): the original offsets [start, stop) of the pieces,
    in order."""
    gone = (spans.groupBy("doc_id", "text_h")
            .agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone")))
    d = docs.select(F.struct(*docs.columns).alias("all"), "doc_id", "text",
                    F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).alias("text_h"))
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("gone.stop"))
    stops = F.concat(F.col("gone.start"), F.array(n))
    pieces = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"),
                                                                      b.alias("stop"))),
                      lambda p: p["stop"] > p["start"])
    whole = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("stop"))),
                     lambda p: p["stop"] > 0)
    out = (d.join(gone, ["doc_id", "text_h"], "left")
           .withColumn("kept", F.when(F.col("gone").isNull(), whole).otherwise(pieces)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(
        "kept", lambda p: F.substr(F.col("text"), (p["start"] + 1).cast("int"),
                                   (p["stop"] - p["start"]).cast("int"))), ""))
    return out.select(*[text.alias(c) if c == "text" else F.col("all")[c].alias(c)
                        for c in docs.columns if c != "kept"], "kept")


def op3_query(docs: DataFrame) -> DataFrame:
    """Every repeated passage and line that goes, with its original offsets."""
    return repeats(docs.select("doc_id", "text"), whole_lines=True).drop("text_h")
