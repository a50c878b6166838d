"""Rewrite reachable files to what a reader needs
and measure them (X14, A4-A7, J5, J6).

An entry is shown in full and is one node: its text is shuffled once and
rewritten where it meets its node.  The pruned text of a dependency depends
only on (path, requested names) and on signatures, so it is computed once per
distinct key and joined back to the nodes.  A hub file that every entry reaches
is therefore rewritten a handful of times, not once per entry; the join back is
keyed by the same hot path but carries one row per key on the right side
(adaptive execution splits a hot partition).  The sides that hold file content
are streamed past a hash table of the other one, they are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimctx.functions.bind import let, record
from slimctx.functions.text import TokenExpr, heuristic_tokens, strip_ws
from slimctx.operators.skew import salted_join


def default_request(parsed: DataFrame) -> DataFrame:
    """Default entry symbols: the exported ones, else all.
    Returns (path, syms ARRAY<STRING> sorted)."""
    names_exp = F.transform(F.filter("symbols", lambda s: s["is_exported"]), lambda s: s["name"])
    names_all = F.transform("symbols", lambda s: s["name"])
    syms = F.when(F.size(names_exp) > 0, names_exp).otherwise(names_all)
    return parsed.select("path", F.array_sort(F.array_distinct(syms)).alias("syms"))


def _kept(hit: Column, requested: Column) -> Column:
    # nothing matched a non-empty request → keep every symbol
    return F.when((F.size(hit) == 0) & (F.size(requested) > 0), F.col("symbols")).otherwise(hit)


def _source(form: str, requested: Column) -> Column:
    """STRUCT<source, names, stmts> of a file: the rewritten text with symbols
    as ``form`` (text or sig), the names matched and the import statements.
    Each array is bound once: lambdas would compute it per element."""
    def found(hit: Column) -> Column:
        return let(_kept(hit, requested), lambda kept: let(
            F.array_distinct(F.flatten(F.transform(kept, lambda s: s["used"]))), lambda used: imports(hit, kept, used)))

    def imports(hit: Column, kept: Column, used: Column) -> Column:
        imps = F.filter("imports", lambda i: F.array_contains(used, i["local_name"]) | (i["local_name"] == "*"))
        return let(imps, lambda imps: let(firsts(imps), lambda stmts: written(hit, kept, stmts)))

    def firsts(imps: Column) -> Column:
        # first import statement per used specifier, statements in file order
        specs = F.array_distinct(F.transform(imps, lambda i: i["specifier"]))
        return F.array_sort(F.array_distinct(F.transform(specs, lambda sp: F.element_at(
            F.transform(F.filter(imps, lambda i: i["specifier"] == sp),
                        lambda i: F.struct(i["line"].alias("line"), i["stmt"].alias("stmt"))), 1))))

    def written(hit: Column, kept: Column, stmts: Column) -> Column:
        lines = F.transform(stmts, lambda x: x["stmt"])
        head = F.when(F.size(stmts) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
        blocks = F.transform(kept, lambda s: F.concat(F.lit("\n"), s[form], F.lit("\n")))
        return record(source=F.concat(strip_ws(F.concat(head, F.array_join(blocks, ""))), F.lit("\n")),
                      names=F.transform(hit, lambda s: s["name"]), stmts=lines)

    return let(F.filter("symbols", lambda s: F.array_contains(requested, s["name"])), found)


def used_import_statements(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """Per (path, request) the import statements the kept symbols
    need, first statement per specifier, in file order."""
    j = requests.select("path", "syms").join(parsed.select("path", "symbols", "imports"), "path", "inner")
    return (j.select("path", "syms", _source("sig", F.col("syms")).alias("r"))
            .select("path", "syms", F.col("r.names").alias("kept"), "r.stmts"))


def _rewritten(keys: DataFrame, parsed: DataFrame, form: str, token_expr: TokenExpr) -> DataFrame:
    """``keys(path, syms, ...)`` with the rewritten source, the kept symbol
    names (in file order, matches only) and the source's tokens."""
    # keys are slim; file content is streamed past them and not sorted
    on = "entry" if "entry" in keys.columns else "path"
    files = parsed.select(F.col("path").alias(on), "symbols", "imports")
    j = keys.hint("shuffle_hash").join(files, on, "inner")
    out = (j.select(*keys.columns, _source(form, F.col("syms")).alias("r"))
           .select(*keys.columns, "r.source", F.col("r.names").alias("symbols")))
    return out.select("*", token_expr(F.col("source")).alias("estimated_tokens"))


def prune(nodes: DataFrame, parsed: DataFrame, token_expr: TokenExpr = heuristic_tokens,
          root: str | None = None, slim: DataFrame | None = None) -> DataFrame:
    """``pruned(entry, path, rel_path, depth, is_entry, symbols, source,
    estimated_tokens)`` — the entry in full, every dependency as signatures.
    ``slim``: ``parsed`` without the symbols' texts, where there is such a table."""
    slim = parsed if slim is None else slim
    n = nodes.select("entry", "path", "depth", "syms")
    # dealt out by entry, which is the path: per entry, the texts need no further shuffle
    entries = (_rewritten(n.where(F.col("depth") == 0).drop("path"), parsed, "text", token_expr)
               .withColumn("path", F.col("entry")).withColumn("is_entry", F.lit(True)))
    others = n.where(F.col("depth") > 0)
    texts = _rewritten(others.select("path", "syms").distinct(), slim, "sig", token_expr)
    # the request is part of the key as an array: joined names could collide;
    # texts are the large side here, so they are not repeated for salts
    rows = entries.unionByName(others.join(texts, ["path", "syms"]).withColumn("is_entry", F.lit(False))
                               .select(*entries.columns))
    return (rows.withColumn("rel_path", relative_path(F.col("path"), root))
            .select("entry", "path", "rel_path", "depth", "is_entry", "symbols", "source",
                    "estimated_tokens"))


def relative_path(path: Column, root: str | None) -> Column:
    """The path below ``root``; paths outside of it stay whole (P10)."""
    if not root:
        return path
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def raw_tokens(files: DataFrame, token_expr: TokenExpr = heuristic_tokens) -> DataFrame:
    """(path, raw_bytes, raw_tokens) of the unpruned files."""
    return files.select("path", F.octet_length("text").alias("raw_bytes"),
                        token_expr(F.col("text")).alias("raw_tokens"))


def _idiv(n: Column, d: Column) -> Column:
    """Exact integer quotient of non-negative longs (as a double)."""
    return (n - n % d) / d


def pct2(num: Column, den: Column) -> Column:
    """``round(num / den * 100, 2)`` rounded half away from zero on the exact
    ratio (integer arithmetic, so every engine agrees); 0.0 when den = 0."""
    q = _idiv(F.abs(num) * 20000 + den, den * 2)
    return F.when(den == 0, F.lit(0.0)).otherwise(F.signum(num) * q / 100.0)


def ratio2(num: Column, den: Column) -> Column:
    """``round(num / den, 2)``; infinity when den = 0."""
    return F.when(den == 0, F.lit(float("inf"))).otherwise(_idiv(num * 200 + den, den * 2) / 100.0)


def bench_files(nodes: DataFrame, pruned: DataFrame, raw: DataFrame) -> DataFrame:
    """Per entry and reachable file: raw vs pruned tokens."""
    p = pruned.select("entry", "path", "estimated_tokens")
    j = (salted_join(nodes.select("entry", "path", "depth"), raw, ["path"])
         .join(p, ["entry", "path"], "left"))
    pt = F.coalesce(F.col("estimated_tokens"), F.lit(0)).cast("bigint")
    return j.select("entry", "path", "depth", "raw_bytes", "raw_tokens", pt.alias("pruned_tokens"),
                    pct2(F.col("raw_tokens") - pt, F.col("raw_tokens")).alias("reduction_pct"))


def bench(per_file: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Per entry: baseline vs pruned totals and derived ratios."""
    g = (per_file.groupBy("entry")
         .agg(F.count(F.lit(1)).alias("baseline_files"),
              F.sum("raw_tokens").cast("bigint").alias("baseline_tokens"),
              F.count(F.lit(1)).alias("pruned_files"),
              F.sum("pruned_tokens").cast("bigint").alias("pruned_tokens"),
              F.sum("raw_bytes").cast("bigint").alias("raw_bytes")))
    saved = F.col("baseline_tokens") - F.col("pruned_tokens")
    return (g.join(seeds.select("entry", F.col("syms").alias("requested_symbols")), "entry", "inner")
            .select("entry", "requested_symbols", F.lit(depth).alias("depth"),
                    "baseline_files", "baseline_tokens", "pruned_files", "pruned_tokens", "raw_bytes",
                    saved.alias("tokens_saved"),
                    pct2(saved, F.col("baseline_tokens")).alias("reduction_pct"),
                    ratio2(F.col("baseline_tokens"), F.col("pruned_tokens")).alias("compression_ratio")))


def request_totals(bench_rows: DataFrame, request: Column) -> DataFrame:
    """Several entries benchmarked as one request — totals and the
    weighted reduction (Σsaved / Σbaseline), only for requests of more than
    one file with a positive baseline."""
    g = (bench_rows.groupBy(request.alias("request"))
         .agg(F.count(F.lit(1)).alias("files"),
              F.sum("baseline_tokens").cast("bigint").alias("baseline_tokens"),
              F.sum("pruned_tokens").cast("bigint").alias("pruned_tokens"),
              F.sum("tokens_saved").cast("bigint").alias("tokens_saved"),
              F.sum("baseline_files").cast("bigint").alias("files_traversed")))
    return g.select("*", F.when((F.col("files") > 1) & (F.col("baseline_tokens") > 0),
                                pct2(F.col("tokens_saved"), F.col("baseline_tokens")))
                    .alias("weighted_reduction_pct"))
