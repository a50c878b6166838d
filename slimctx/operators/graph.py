"""Symbol-level dependency edges and bounded traversal.

``symbol_edges`` — which imported names each symbol's text uses.  Symbols
and imports of a file sit in the same row, so this is an in-row filter;
only the slim edge rows are exploded and joined to the resolution table.

``bfs`` — level-synchronous breadth-first traversal from any number of
entries at once over rows ``(entry, path, syms)``.  Per level: one join of
the frontier with the edges, one group-by on (entry, path), one anti join
with what each entry has already visited.  A node is expanded once, with
the names asked for by the level that discovered it; names merged later
(diamonds, cycles) are kept for output but not followed (SURVEY T1).
``closure`` — the order-free alternative: (path, name) fixpoint within the
depth bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimctx.operators.extract import explode_rows
from slimctx.operators.skew import salted_join
from slimctx.session import materialize


def symbol_edges(parsed: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Returns ``(sym_edges, star_edges)``.

    sym_edges(src, src_sym, specifier, dst, dst_sym) — one row per symbol,
      imported name it uses and resolved target (``edges_all``: two
      specifiers for one target give two rows, SURVEY T9).
    star_edges(src, specifier, dst) — ``from m import *`` targets, followed
      from any visited file regardless of its symbols.
    """
    per_sym = F.flatten(F.transform(
        "symbols",
        lambda s: F.transform(F.filter("imports", lambda i: F.array_contains(s["used"], i["local_name"])),
                              lambda i: F.struct(s["name"].alias("src_sym"), i["specifier"].alias("specifier"),
                                                 i["export_name"].alias("dst_sym")))))
    sym = (explode_rows(parsed.select(F.col("path").alias("src"), "symbols", "imports"), ["src"],
                        F.array_distinct(per_sym), "e")
           .select("src", "e.*")
           .where(F.col("specifier").startswith(".")))
    sym_edges = sym.join(resolved, ["src", "specifier"], "inner")
    star = (explode_rows(parsed.select(F.col("path").alias("src"), "imports"), ["src"],
                         F.array_distinct(F.transform(F.filter("imports", lambda i: i["local_name"] == "*"),
                                                      lambda i: i["specifier"])), "specifier")
            .where(F.col("specifier").startswith(".")))
    star_edges = star.join(resolved, ["src", "specifier"], "inner")
    return sym_edges, star_edges


def bfs(seeds: DataFrame, sym_edges: DataFrame, star_edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """Traverse from ``seeds(entry, syms ARRAY<STRING>)`` (the entry file is
    the path).  Returns ``nodes(entry, path, depth, syms)`` where ``syms``
    is every name asked of the file (sorted), ``depth`` its first discovery.
    """
    edges = sym_edges.select(F.col("src").alias("path"), F.col("src_sym").alias("sym"), "dst", "dst_sym")
    stars = star_edges.select(F.col("src").alias("path"), "dst").distinct()
    start = seeds.select("entry", F.col("entry").alias("path"),
                         F.coalesce("syms", F.array().cast("array<string>")).alias("syms"))
    levels = [start.withColumn("depth", F.lit(0))]
    visited = start.select("entry", "path")
    frontier = start
    for level in range(1, max_depth + 1):
        # hub files make one path hot on the frontier side: the join is salted
        by_sym = (salted_join(frontier.select("entry", "path", F.explode("syms").alias("sym")),
                              edges, ["path", "sym"])
                  .select("entry", F.col("dst").alias("path"), F.col("dst_sym").alias("sym")))
        by_star = (salted_join(frontier.select("entry", "path"), stars, ["path"])
                   .select("entry", F.col("dst").alias("path"), F.lit("*").alias("sym")))
        asked = (by_sym.unionByName(by_star)
                 .groupBy("entry", "path")
                 .agg(F.array_sort(F.collect_set("sym")).alias("syms")))
        asked = materialize(asked, "level")   # read by the next level and the final union
        levels.append(asked.withColumn("depth", F.lit(level)))
        if level == max_depth:
            break
        frontier = materialize(asked.join(visited, ["entry", "path"], "left_anti"))
        visited = visited.unionByName(frontier.select("entry", "path"))
    allv = levels[0]
    for lv in levels[1:]:
        allv = allv.unionByName(lv)
    # first discovery fixes the depth; every request (incl. later merges) is listed
    first = (allv.groupBy("entry", "path")
             .agg(F.min("depth").alias("depth"),
                  F.array_sort(F.array_distinct(F.flatten(F.collect_list("syms")))).alias("syms")))
    return materialize(first, "nodes")      # read by the rewrite, its join-back and the benchmark


def closure(seeds: DataFrame, sym_edges: DataFrame, star_edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """Order-free mode: every (path, name) reachable within ``max_depth``
    hops is expanded, whatever level first reached the file.  Semi-naive:
    each level only expands (entry, path, name) triples not seen before."""
    edges = sym_edges.select(F.col("src").alias("path"), F.col("src_sym").alias("sym"), "dst", "dst_sym")
    stars = star_edges.select(F.col("src").alias("path"), "dst").distinct()
    start = (seeds.select("entry", F.col("entry").alias("path"),
                          F.explode_outer("syms").alias("sym"))
             .withColumn("depth", F.lit(0)))
    seen = start.select("entry", "path", "sym")
    delta = start.select("entry", "path", "sym")
    parts = [start]
    for level in range(1, max_depth + 1):
        by_sym = (salted_join(delta, edges, ["path", "sym"])
                  .select("entry", F.col("dst").alias("path"), F.col("dst_sym").alias("sym")))
        new_files = delta.select("entry", "path").distinct()
        by_star = (salted_join(new_files, stars, ["path"])
                   .select("entry", F.col("dst").alias("path"), F.lit("*").alias("sym")))
        nxt = by_sym.unionByName(by_star).distinct().join(seen, ["entry", "path", "sym"], "left_anti")
        nxt = materialize(nxt, "level")
        parts.append(nxt.withColumn("depth", F.lit(level)))
        seen = seen.unionByName(nxt)
        delta = nxt
    allv = parts[0]
    for p in parts[1:]:
        allv = allv.unionByName(p)
    return materialize(allv.groupBy("entry", "path")
                       .agg(F.min("depth").alias("depth"),
                            F.array_sort(F.collect_set("sym")).alias("syms")), "nodes")
