"""Registered corpus queries: each takes (spark, sf_dir) and runs over the
whole corpus derived from ``documents`` (every file an entry where entries
matter).  Array results are also given as comma-joined text so they compare
as plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimctx.functions.bind import let, record
from slimctx.functions.paths import SUPPORTED_EXTS, extension_of, language_of
from slimctx.functions.text import IDENT_RE, heuristic_tokens, lossy_utf8, split_names
from slimctx.operators import prune as P
from slimctx.operators.extract import explode_rows, imports_table, parse_files, symbols_table
from slimctx.plans.api import CorpusIndex, render_json, render_text
from slimctx.sources.corpus import load_corpus
from slimctx.sources.tables import table
from slimctx.sources.usage_log import append_log, read_log
from slimctx.session import materialize, scratch_dir

# Fixed value: the symbol request used by ``requested_or_all`` (comma list
# with blanks and an empty item on purpose).
REQUEST = "fn_0, f_1 ,, Shape2, V_3, default"


def _csv(c) -> F.Column:
    return F.array_join(c, ",")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(load_corpus(spark, sf_dir))


_INDEX_CACHE: dict = {}


def _index(spark: SparkSession, sf_dir: str) -> CorpusIndex:
    """One materialised index per (session, folder) — the parse, resolution
    and edge tables are shared by the queries of one driver run."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEX_CACHE:
        _INDEX_CACHE[key] = CorpusIndex(load_corpus(spark, sf_dir))
    return _INDEX_CACHE[key]


# ------------------------------------------------------------------ scan

def q_corpus_language_counts(spark, sf_dir):
    f = load_corpus(spark, sf_dir)
    return (f.groupBy("language")
            .agg(F.count(F.lit(1)).alias("files"),
                 F.sum(F.octet_length("text")).cast("bigint").alias("raw_bytes"),
                 F.sum(heuristic_tokens(F.col("text"))).cast("bigint").alias("raw_tokens"),
                 F.sum(extension_of(F.col("path")).isin(*SUPPORTED_EXTS).cast("int")).cast("bigint")
                 .alias("supported")))


# ------------------------------------------------------------ extraction

_SYM_COLS = ["path", "ord", "name", "kind", "start_line", "decl_line", "end_line", "is_exported", "has_body"]


def _symbols(spark, sf_dir, lang):
    s = symbols_table(_parsed(spark, sf_dir))
    return s.where(F.col("language") == lang).select(*_SYM_COLS)


def q_symbols_py(spark, sf_dir):
    return _symbols(spark, sf_dir, "python")


def q_symbols_js(spark, sf_dir):
    return _symbols(spark, sf_dir, "javascript")


def q_symbols_ts(spark, sf_dir):
    return _symbols(spark, sf_dir, "typescript")


def _imports(spark, sf_dir, py: bool):
    i = imports_table(_parsed(spark, sf_dir))
    cond = F.col("language") == "python"
    return i.where(cond if py else ~cond).select("path", "line", "local_name", "export_name", "specifier")


def q_imports_py(spark, sf_dir):
    return _imports(spark, sf_dir, True)


def q_imports_js(spark, sf_dir):
    return _imports(spark, sf_dir, False)


def q_identifiers_per_symbol(spark, sf_dir):
    s = symbols_table(_parsed(spark, sf_dir))
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(IDENT_RE), 1))
    return s.select("path", "ord", "name", F.size(ids).alias("n_identifiers"),
                    _csv(F.array_sort("used")).alias("used"))


def _strip(spark, sf_dir, cond):
    s = symbols_table(_parsed(spark, sf_dir))
    return s.where(cond).select("path", "ord", "name", "kind", "sig")


def q_strip_python(spark, sf_dir):
    return _strip(spark, sf_dir, (F.col("language") == "python") & F.col("has_body"))


def q_strip_js(spark, sf_dir):
    return _strip(spark, sf_dir, (F.col("language") != "python") & (F.col("kind") == "function"))


def q_strip_class(spark, sf_dir):
    return _strip(spark, sf_dir, (F.col("language") != "python") & (F.col("kind") == "class"))


def q_symbol_bytes(spark, sf_dir):
    """Byte spans, and whether the file's bytes there are the symbol's text."""
    parsed = parse_files(load_corpus(spark, sf_dir).withColumn("content", F.encode("text", "utf-8")))
    rows = let(F.col("content"), lambda b: F.transform("symbols", lambda s: record(
        ord=s["ord"], name=s["name"], start_byte=s["start_byte"], end_byte=s["end_byte"],
        same=F.substring(b, s["start_byte"] + 1, s["end_byte"] - s["start_byte"])
        == F.encode(s["text"], "utf-8"))))
    return explode_rows(parsed, ["path"], rows, "s").select("path", "s.*")


def q_default_exports(spark, sf_dir):
    d = P.default_request(_parsed(spark, sf_dir))
    return d.select("path", F.size("syms").alias("n"), _csv("syms").alias("syms"))


def q_requested_or_all(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    req = F.array_sort(F.array_distinct(split_names(F.lit(REQUEST))))
    hit = F.filter("symbols", lambda s: F.array_contains(req, s["name"]))
    fallback = (F.size(hit) == 0) & (F.size(req) > 0)
    kept = F.when(fallback, F.col("symbols")).otherwise(hit)
    return parsed.select("path", fallback.alias("fallback"), F.size(kept).alias("n_kept"),
                         _csv(F.transform(kept, lambda s: s["name"])).alias("kept"))


def q_used_imports(spark, sf_dir):
    # parsed once, without texts: both sides of the join read this table
    slim = F.transform("symbols", lambda s: record(name=s["name"], is_exported=s["is_exported"],
                                                   sig=F.lit(""), used=s["used"]))
    parsed = materialize(_parsed(spark, sf_dir).select("path", slim.alias("symbols"), "imports"))
    req = P.default_request(parsed)
    u = P.used_import_statements(parsed, req)
    return u.select("path", F.size("stmts").alias("n_stmts"), F.array_join("stmts", "\n").alias("stmts"))


# ------------------------------------------------------ resolution, graph

def q_resolve_specifiers(spark, sf_dir):
    return _index(spark, sf_dir).resolved.select("src", "specifier", "dst")


def q_symbol_edges(spark, sf_dir):
    return _index(spark, sf_dir).sym_edges.select("src", "src_sym", "specifier", "dst", "dst_sym")


def q_needed_imports(spark, sf_dir):
    e = _index(spark, sf_dir).sym_edges
    return (e.groupBy("src", "specifier")
            .agg(F.array_sort(F.collect_set("dst_sym")).alias("names"))
            .select("src", "specifier", F.size("names").alias("n"), _csv("names").alias("names")))


def _nodes(spark, sf_dir, mode):
    idx = _index(spark, sf_dir)
    return idx.graph(idx.seeds(), 3, mode)


def q_bfs_depth3(spark, sf_dir):
    return _nodes(spark, sf_dir, "bfs").select("entry", "path", "depth", _csv("syms").alias("syms"))


def q_closure_depth3(spark, sf_dir):
    return _nodes(spark, sf_dir, "closure").select("entry", "path", "depth", _csv("syms").alias("syms"))


def q_cycles_diamonds(spark, sf_dir):
    """Entries whose own node received names back through a cycle: the
    merged request differs from the initial one (SURVEY T1/T2).  Diamond
    merges are covered by the traversal tests on small corpora."""
    idx = _index(spark, sf_dir)
    seeds = idx.seeds()
    nodes = idx.graph(seeds, 3, "bfs")
    back = (nodes.where(F.col("path") == F.col("entry"))
            .join(seeds.select("entry", F.col("syms").alias("initial")), "entry")
            .where(F.col("syms") != F.col("initial")))
    return back.select("entry", _csv("initial").alias("initial"), _csv("syms").alias("merged"),
                       _csv(F.array_except("syms", "initial")).alias("added"))


# ------------------------------------------------------------ rewrite

def _sweep_pruned(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.prune(idx.seeds())


def q_prune_files(spark, sf_dir):
    p = _sweep_pruned(spark, sf_dir)
    return p.select("entry", "path", "rel_path", "depth", "is_entry", _csv("symbols").alias("symbols"),
                    "source", "estimated_tokens")


def q_render_text(spark, sf_dir):
    return render_text(_sweep_pruned(spark, sf_dir))


JSON_SCHEMA = ("entry string, requested_symbols array<string>, total_tokens bigint, files array<struct<path:string,"
               "rel_path:string,depth:int,is_entry:boolean,symbols:array<string>,source:string,"
               "estimated_tokens:bigint>>")


def q_render_json(spark, sf_dir):
    """The JSON documents of all entries, parsed back to one row per file."""
    idx = _index(spark, sf_dir)
    seeds = idx.seeds()
    docs = render_json(idx.prune(seeds), seeds).select(F.from_json("json", JSON_SCHEMA).alias("d"))
    return (docs.select("d.entry", "d.total_tokens", _csv("d.requested_symbols").alias("requested_symbols"),
                        F.explode("d.files").alias("f"))
            .select("entry", "total_tokens", "requested_symbols", "f.path", "f.rel_path", "f.depth", "f.is_entry",
                    _csv("f.symbols").alias("symbols"), "f.source", "f.estimated_tokens"))


def q_prune_below_root(spark, sf_dir):
    """Paths shown relative to one directory; files outside keep theirs (P10)."""
    idx = _index(spark, sf_dir)
    return idx.prune(idx.seeds(), root="src/p1").select("entry", "path", "rel_path", "depth")


def q_token_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.length("text").alias("chars"), heuristic_tokens(F.col("text")).alias("tokens"))


def q_token_totals(spark, sf_dir):
    idx = _index(spark, sf_dir)
    b, _ = idx.benchmark(idx.seeds())
    return b.agg(F.count(F.lit(1)).alias("entries"),
                 F.sum("baseline_files").cast("bigint").alias("files"),
                 F.sum("baseline_tokens").cast("bigint").alias("baseline_tokens"),
                 F.sum("pruned_tokens").cast("bigint").alias("pruned_tokens"),
                 F.sum("tokens_saved").cast("bigint").alias("tokens_saved"))


def _bench(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return idx.benchmark(idx.seeds())


def q_bench_entry(spark, sf_dir):
    b, _ = _bench(spark, sf_dir)
    return b.select("entry", _csv("requested_symbols").alias("requested_symbols"), "depth", "baseline_files",
                    "baseline_tokens", "pruned_files", "pruned_tokens", "raw_bytes", "tokens_saved",
                    "reduction_pct", "compression_ratio")


def q_bench_files(spark, sf_dir):
    _, f = _bench(spark, sf_dir)
    return f.select("entry", "path", "depth", "raw_bytes", "raw_tokens", "pruned_tokens", "reduction_pct")


def q_bench_request_totals(spark, sf_dir):
    """Every directory's entries benchmarked as one multi-file request."""
    from slimctx.functions.paths import dirname
    b, _ = _bench(spark, sf_dir)
    return P.request_totals(b, dirname(F.col("entry")))


def q_sweep_top_savers(spark, sf_dir):
    b, _ = _bench(spark, sf_dir)
    return (b.orderBy(F.col("tokens_saved").desc(), F.col("entry").asc()).limit(10)
            .select("entry", "baseline_files", "baseline_tokens", "pruned_tokens", "tokens_saved",
                    "reduction_pct", "compression_ratio"))


# ------------------------------------------------------------ sources

def q_invalid_utf8(spark, sf_dir):
    """Whole document bytes with a dangling lead byte in front and an
    invalid byte behind, decoded lossily: two replacement characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = F.concat(F.unhex(F.lit("C3")), F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    txt = lossy_utf8(raw)
    return d.select("doc_id", F.length(txt).alias("chars"),
                    (F.length(txt) - F.length(F.regexp_replace(txt, "�", ""))).alias("replaced"),
                    F.octet_length(raw).alias("raw_bytes"))


def q_unparseable_skipped(spark, sf_dir):
    """Web pages dropped into the tree as .html assets: the supported-
    extension filter (P6) keeps them out of the corpus."""
    code = load_corpus(spark, sf_dir).select("path", "text")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("web/page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("text"))
    skipped = code.unionByName(pages).where(~extension_of(F.col("path")).isin(*SUPPORTED_EXTS))
    return skipped.select("path", extension_of(F.col("path")).alias("ext"),
                          language_of(F.col("path")).alias("read_as"),
                          heuristic_tokens(F.col("text")).alias("raw_tokens"))


def q_log_append_roundtrip(spark, sf_dir):
    """Benchmark rows appended to a usage log (JSON lines) and read back."""
    b, _ = _bench(spark, sf_dir)
    rows = b.select(F.lit("2026-01-01T00:00:00Z").alias("ts"), F.col("entry").alias("file"),
                    F.col("requested_symbols").alias("symbols"), F.col("depth").cast("bigint").alias("depth"),
                    "baseline_tokens", "pruned_tokens", "tokens_saved", "reduction_pct",
                    F.col("baseline_files").cast("bigint").alias("files_traversed"),
                    F.lit(None).cast("bigint").alias("request_id"))
    out = scratch_dir(spark, "usage-log")
    append_log(rows, out)
    back = read_log(spark, out)
    return back.select("ts", "file", _csv("symbols").alias("symbols"), "depth", "baseline_tokens",
                       "pruned_tokens", "tokens_saved", "reduction_pct", "files_traversed")


CORPUS_QUERIES = {
    "corpus_language_counts": q_corpus_language_counts,
    "symbols_py": q_symbols_py,
    "symbols_js": q_symbols_js,
    "symbols_ts": q_symbols_ts,
    "imports_py": q_imports_py,
    "imports_js": q_imports_js,
    "identifiers_per_symbol": q_identifiers_per_symbol,
    "default_exports": q_default_exports,
    "requested_or_all": q_requested_or_all,
    "used_imports": q_used_imports,
    "resolve_specifiers": q_resolve_specifiers,
    "needed_imports": q_needed_imports,
    "symbol_edges": q_symbol_edges,
    "bfs_depth3": q_bfs_depth3,
    "closure_depth3": q_closure_depth3,
    "cycles_diamonds": q_cycles_diamonds,
    "strip_python": q_strip_python,
    "strip_js": q_strip_js,
    "strip_class": q_strip_class,
    "symbol_bytes": q_symbol_bytes,
    "prune_files": q_prune_files,
    "render_text": q_render_text,
    "render_json": q_render_json,
    "prune_below_root": q_prune_below_root,
    "token_estimate": q_token_estimate,
    "token_totals": q_token_totals,
    "bench_entry": q_bench_entry,
    "bench_files": q_bench_files,
    "bench_request_totals": q_bench_request_totals,
    "sweep_top_savers": q_sweep_top_savers,
    "invalid_utf8": q_invalid_utf8,
    "unparseable_skipped": q_unparseable_skipped,
    "log_append_roundtrip": q_log_append_roundtrip,
}

