"""User-level calls (E1-E6) and renderers.

    idx = CorpusIndex(files)                      # parse + resolve + edges
    seeds = idx.seeds(entries=["src/a.py"], symbols="greet")
    idx.prune(seeds)                              # E1, all entries in one job
    idx.benchmark(seeds)                          # E2 -> (bench, bench_files)
    idx.sweep()                                   # E4, every file is an entry
    idx.graph(seeds)                              # E5 -> nodes

Everything is lazy DataFrames; the only eager step is the optional
materialisation of the parsed corpus (it feeds four branches).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimctx.functions.text import TokenExpr, heuristic_tokens, split_names
from slimctx.operators import graph as G
from slimctx.operators import prune as P
from slimctx.operators.extract import parse_files, with_texts, with_texts_apart
from slimctx.operators.resolve import resolve_specifiers
from slimctx.session import materialize as _materialize


class CorpusIndex:
    def __init__(self, files: DataFrame, materialize: bool = True,  # noqa: F811
                 token_expr: TokenExpr = heuristic_tokens, listing: DataFrame | None = None):
        """``listing``: every path of the tree, when some of its files could not
        be read; imports may then resolve to files that ``files`` lacks."""
        self.spark = files.sparkSession
        self.files = files
        self.token_expr = token_expr
        # raw size and tokens ride along with the parse, so the text is read once
        measured = files.select("path", "language", "text", F.octet_length("text").alias("raw_bytes"),
                                token_expr(F.col("text")).alias("raw_tokens"))
        apart = with_texts_apart(parse_files(measured))
        if materialize:
            # written table in the shared checkpoint folder: cuts lineage and
            # survives executor loss (never a local checkpoint)
            apart = _materialize(apart)
        self.parsed = with_texts(apart)
        #: ``parsed`` without the symbols' texts, which only entries need
        self.slim = parsed = apart.drop("texts")
        self.paths = parsed.select("path")
        self.resolved = resolve_specifiers(parsed, listing if listing is not None else self.paths)
        if materialize:
            self.resolved = _materialize(self.resolved)
        sym_edges, star_edges = G.symbol_edges(parsed, self.resolved)
        if materialize:
            # read once per traversal level
            sym_edges, star_edges = _materialize(sym_edges), _materialize(star_edges)
        #: all edges, also to files that could not be read
        self.sym_edges, self.star_edges = sym_edges, star_edges
        readable = self.paths.select(F.col("path").alias("dst"))
        self._open_sym, self._open_star = (
            (sym_edges, star_edges) if listing is None else
            (sym_edges.join(readable, "dst", "left_semi"), star_edges.join(readable, "dst", "left_semi")))

    # ------------------------------------------------------------ seeds
    def seeds(self, entries: Iterable[str] | DataFrame | None = None,
              symbols: str | list[str] | None = None) -> DataFrame:
        """``(entry, syms)``.  ``entries`` — paths, a DataFrame with column
        ``entry`` (and optionally ``syms``), or None for every file.
        ``symbols`` — comma list or list applied to all entries; missing →
        exported symbols (else all) of each entry."""
        if entries is None and not symbols:
            return P.default_request(self.slim).select(F.col("path").alias("entry"), "syms")
        if entries is None:
            ent = self.paths.select(F.col("path").alias("entry"))
        elif isinstance(entries, DataFrame):
            ent = entries
        else:
            ent = self.spark.createDataFrame([(e,) for e in entries], "entry string")
        if "syms" in ent.columns:
            return ent.select("entry", F.array_sort(F.array_distinct("syms")).alias("syms"))
        if symbols:
            text = symbols if isinstance(symbols, str) else ",".join(symbols)
            names = F.array_sort(F.array_distinct(split_names(F.lit(text))))
            return ent.select("entry", names.alias("syms"))
        dflt = P.default_request(self.slim).select(F.col("path").alias("entry"), "syms")
        return (ent.select("entry").join(dflt, "entry", "left")
                .select("entry", F.coalesce("syms", F.array().cast("array<string>")).alias("syms")))

    # ------------------------------------------------------------ graph
    def graph(self, seeds: DataFrame, depth: int = 3, mode: str = "bfs") -> DataFrame:
        """E5: ``nodes(entry, path, depth, syms)``; only files of the corpus
        become nodes (unresolved imports are dropped, P5/P12)."""
        fn = G.bfs if mode == "bfs" else G.closure
        return fn(seeds, self._open_sym, self._open_star, depth)

    def file_edges(self) -> DataFrame:
        """(src, specifier, dst, readable): a dependency that cannot be read
        keeps its edge, its file is skipped by the traversal (P12)."""
        known = self.paths.select(F.col("path").alias("dst"), F.lit(True).alias("known"))
        edges = self.sym_edges.select("src", "specifier", "dst").unionByName(
            self.star_edges.select("src", "specifier", "dst")).distinct()
        return edges.join(known, "dst", "left").select(
            "src", "specifier", "dst", F.coalesce("known", F.lit(False)).alias("readable"))

    def prune(self, seeds: DataFrame, depth: int = 3, mode: str = "bfs", root: str | None = None) -> DataFrame:
        """One row per (entry, reachable file) with the pruned source."""
        nodes = self.graph(seeds, depth, mode)
        return P.prune(nodes, self.parsed, self.token_expr, root, self.slim)

    def benchmark(self, seeds: DataFrame, depth: int = 3, mode: str = "bfs") -> tuple[DataFrame, DataFrame]:
        """``(bench, bench_files)``; both token columns come from the same
        traversal (J6), nothing is recomputed."""
        nodes = self.graph(seeds, depth, mode)
        pruned = P.prune(nodes, self.parsed, self.token_expr, slim=self.slim)
        per_file = P.bench_files(nodes, pruned, self.slim.select("path", "raw_bytes", "raw_tokens"))
        return P.bench(per_file, seeds, depth), per_file

    def sweep(self, depth: int = 3, mode: str = "bfs") -> DataFrame:
        """The benchmark with every file of the corpus as entry."""
        b, _ = self.benchmark(self.seeds(), depth, mode)
        return b


# --------------------------------------------------------------- renderers

def _per_entry(pruned: DataFrame, shown: Column) -> tuple[DataFrame, DataFrame]:
    """Per entry the parts of the entry's own file and those of its other
    files.  ``prune`` deals the long texts out by entry already, so that only
    the signatures are shuffled here."""
    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("entry").agg(
            F.struct(F.collect_list(F.struct("depth", "path", shown.alias("f"))).alias("parts"),
                     F.sum("estimated_tokens").alias("tokens")).alias(name))

    return parts(pruned.where("is_entry"), "own"), parts(pruned.where("not is_entry"), "others")


def _both(joined: DataFrame) -> DataFrame:
    """The parts in depth order, ties by path, and their totals."""
    sides = [F.col("own"), F.col("others")]
    none = joined.schema["own"].dataType["parts"].dataType
    parts = F.array_sort(F.concat(*[F.coalesce(c["parts"], F.array().cast(none)) for c in sides]))
    tokens = F.when(F.coalesce(*[c["tokens"] for c in sides]).isNotNull(),
                    sum(F.coalesce(c["tokens"], F.lit(0)) for c in sides))
    return (joined.withColumn("parts", parts).withColumn("total_tokens", tokens.cast("bigint"))
            .withColumn("files", F.size("parts").cast("bigint")).drop("own", "others"))


def render_text(pruned: DataFrame) -> DataFrame:
    """One text document per entry — per file a header line, the
    trimmed source and a blank line, then a footer with the totals.
    Files in depth order, ties by path."""
    block = F.concat(F.lit("# === "), F.col("rel_path"), F.lit(" ("), F.col("estimated_tokens").cast("string"),
                     F.lit(" tokens) ===\n"),
                     F.regexp_replace(F.regexp_replace("source", r"\s+$", ""), r"^\s+", ""), F.lit("\n"))
    own, others = _per_entry(pruned, block)
    per = _both(own.join(others.hint("shuffle_hash"), "entry", "full_outer"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["f"]), "\n"),
                    F.lit("\n# ---\n# Total: "), F.col("total_tokens").cast("string"), F.lit(" tokens across "),
                    F.col("files").cast("string"), F.lit(" file(s)\n"))
    return per.select("entry", "total_tokens", "files", text.alias("text"))


def render_blocks(pruned: DataFrame) -> DataFrame:
    """S7 for entries of any size: (entry, part, depth, path, text) rows, the
    files of an entry (part 0) and its footer (part 1).  Nothing is gathered
    per entry; sorted by all columns but ``text`` the rows are the document."""
    block = F.concat(F.lit("# === "), F.col("rel_path"), F.lit(" ("), F.col("estimated_tokens").cast("string"),
                     F.lit(" tokens) ===\n"),
                     F.regexp_replace(F.regexp_replace("source", r"\s+$", ""), r"^\s+", ""), F.lit("\n"))
    total = pruned.groupBy("entry").agg(F.sum("estimated_tokens").cast("string").alias("t"),
                                        F.count(F.lit(1)).cast("string").alias("n"))
    footer = F.concat(F.lit("# ---\n# Total: "), F.col("t"), F.lit(" tokens across "), F.col("n"), F.lit(" file(s)\n"))
    return (pruned.select("entry", F.lit(0).alias("part"), "depth", "path", block.alias("text"))
            .unionByName(total.select("entry", F.lit(1).alias("part"), F.lit(0).alias("depth"),
                                      F.lit("").alias("path"), footer.alias("text"))))


def write_text(pruned: DataFrame, path: str) -> None:
    """The text documents of all entries in order, as text files."""
    order = ["entry", "part", "depth", "path"]
    (render_blocks(pruned).repartitionByRange(*order).sortWithinPartitions(*order)
     .select("text").write.mode("overwrite").text(path))


def render_json(pruned: DataFrame, seeds: DataFrame) -> DataFrame:
    """One JSON document per entry (fixed key order)."""
    f = F.struct(F.col("path"), F.col("rel_path"), F.col("depth"), F.col("is_entry"), F.col("symbols"),
                 F.col("source"), F.col("estimated_tokens"))
    own, others = _per_entry(pruned, f)
    # the documents are not sorted for these joins: the slim sides are hashed
    requests = seeds.select("entry", F.col("syms").alias("requested_symbols")).hint("shuffle_hash")
    per = _both(requests.join(own, "entry", "left").join(others.hint("shuffle_hash"), "entry", "left")
                .where("own is not null or others is not null"))
    doc = F.struct(F.col("entry"), F.col("requested_symbols"), F.col("total_tokens"),
                   F.transform("parts", lambda p: p["f"]).alias("files"))
    return per.select("entry", "total_tokens", F.to_json(doc).alias("json"))
