"""Import specifier → corpus file.

Each distinct (directory, language, specifier) expands into an ordered candidate list (exact,
extension by importer language, index / package file); the candidates are
equi-joined against the corpus paths and the lowest-ordered hit wins.  The
importers of a hub in one directory thus share one row of candidates, and the
way back to the importing files is a salted join.  Nothing is collected to
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimctx.functions.bind import let
from slimctx.operators.extract import explode_rows
from slimctx.operators.skew import salted_join
from slimctx.functions.paths import (JS_EXTS, JS_INDEX, PY_INDEX, TS_EXTS, dirname, join_path,
                                     normpath, parent_n)


def _cands(paths: list[Column]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("ord"), p.alias("cand")) for i, p in enumerate(paths)])


def candidates(path: Column, language: Column, spec: Column) -> Column:
    """Ordered candidate paths for one relative specifier."""
    # python: leading dots climb packages, the rest is a dotted module path
    dots = F.length(F.regexp_extract(spec, r"^\.+", 0))
    rest = F.substring(spec, dots + 1, 1 << 30)
    base = parent_n(path, dots)
    module = join_path(base, F.regexp_replace(rest, r"\.", "/"))
    py = F.when(rest == "", _cands([join_path(base, F.lit(PY_INDEX.lstrip("/")))])) \
        .otherwise(let(module, lambda m: _cands([F.concat(m, F.lit(".py")), F.concat(m, F.lit(PY_INDEX))])))
    # javascript / typescript: path join + normpath, then extensions, then index files
    raw = normpath(join_path(dirname(path), spec))
    first = lambda exts: let(raw, lambda r: _cands(
        [r] + [F.concat(r, F.lit(e)) for e in exts] + [F.concat(r, F.lit(i)) for i in JS_INDEX]))
    js, ts = first(JS_EXTS), first(TS_EXTS)
    return (F.when(language == "python", py)
            .when(language == "typescript", ts)
            .otherwise(js))


def resolve_specifiers(parsed: DataFrame, corpus_paths: DataFrame) -> DataFrame:
    """(src, specifier) → dst for every relative specifier that resolves.

    ``parsed`` — output of ``parse_files``; ``corpus_paths`` — one column
    ``path`` with every file of the corpus (unique)."""
    specs = (explode_rows(parsed.select(F.col("path").alias("src"), "language", "imports"), ["src", "language"],
                          F.array_distinct(F.transform("imports", lambda i: i["specifier"])), "specifier")
             .where(F.col("specifier").startswith(".")))           # external packages never resolve
    key = ["dir", "language", "specifier"]
    asked = specs.withColumn("dir", dirname(F.col("src")))
    inside = F.when(F.col("dir") == "", F.lit("x")).otherwise(F.concat(F.col("dir"), F.lit("/x")))
    cands = (asked.select(*key).distinct()
             .select(*key, F.explode(candidates(inside, F.col("language"), F.col("specifier"))).alias("c"))
             .select(*key, "c.ord", "c.cand"))
    hits = cands.join(corpus_paths.select(F.col("path").alias("cand")), "cand")
    found = hits.groupBy(*key).agg(F.min_by("cand", "ord").alias("dst"))
    return salted_join(asked, found, key).select("src", "specifier", "dst")
