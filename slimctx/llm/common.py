"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.session import materialize

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are
#: fewer than HOT_SHARE hot keys whatever the size of the data.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    A lambda variable is never inlined by the optimizer, whereas an outer
    column read inside a lambda is replaced by its definition and then
    computed once per array element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the faster ``lower``."""
    return (F.when(F.octet_length(c) == F.length(c), F.lower(c))
            .otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER)))


def digest128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: one 128-bit digest."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def join_unique(big: DataFrame, side: DataFrame, keys: Sequence[str], weight: str,
                total: int) -> DataFrame:
    """Inner join of ``big`` with ``side`` (one row per key) that no hot key
    can stall.

    ``weight`` is the number of rows of ``big`` with the key and ``total`` the
    number of all its rows.  Keys over ``total / HOT_SHARE`` rows (fewer than
    HOT_SHARE keys, so the broadcast is bounded) are joined where they lie;
    all others go through the shuffle."""
    keys = list(keys)
    hot = F.col(weight) * HOT_SHARE > F.lit(total)
    head, tail = F.broadcast(side.filter(hot)), side.filter(~hot)
    return (big.join(head, keys, "inner")
            .unionByName(big.join(F.broadcast(head.select(*keys)), keys, "left_anti")
                         .join(tail, keys, "inner")))


def arrow_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of the Arrow batches that Python tasks get, so that
    long texts come a few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_buffers(column) -> tuple:
    """The UTF-8 bytes and the offsets of an Arrow string column (null: empty),
    as numpy arrays over the whole batch."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:
                                                           column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return data[first:last], offsets - first


def sized_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows."""
    small = df.count() <= max_rows
    return (F.broadcast(df) if small else df), small


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges``: columns (a, b), longs, both directions or one, repeats and
    self-links allowed.  Returns (node, root), root the smallest node of the
    component; nodes without a link to another node are absent.  Every round
    is two aggregations and joins over the edge list, written as a table in
    the shared folder; no list of neighbours is ever gathered, and the join's
    rows of a node with very many links are split by adaptive execution."""
    e = materialize(edges.filter("a <> b")
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                      .alias("h")).first()
        if seen == (state["n"], state["h"]):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (state["n"], state["h"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = materialize(large.join(low, "u").filter("v <> m")
                        .select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select("u", F.col("m").alias("v")))
                        .distinct(), "cc")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
